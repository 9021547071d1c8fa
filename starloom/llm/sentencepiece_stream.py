"""SentencePiece encoding and decoding by a streaming Viterbi search.

Each boundary of the text keeps one backpointer, the last piece of the best
encoding that ends there. A start survives as long as some longer piece may
still begin there, so at most ``max_piece`` boundaries can be extended; they and
the newest boundary are the window. Once all their paths meet in one boundary
the pieces in front of it are committed and forgotten. Which predecessor is best
depends on the model's kind:

* unigram: the greatest sum of piece scores (ties: the longer last piece);
* BPE: there sums of scores do not give the library's ids. The best encoding of
  a prefix is the one that merging by score makes, and a piece extends an
  encoding exactly if merging the text of the two pieces gives back the two
  pieces. That test needs only the last piece, so it is a Viterbi step with one
  survivor a boundary.

Models of other kinds (word, character) are refused.

White space is written as U+2581, with one in front of the text. Every text goes
through the same stream. Where no piece holds the two characters on both sides
of a boundary, no start survives there, so everything is committed and the
stream is as it was at its beginning: what follows depends on nothing in front.
Texts are therefore fed from one such boundary to the next, and what a worker's
stream committed for such a stretch is remembered and not searched again.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import ship, slices

SPACE = "▁"
#: Entries of a worker's memos: committed stretches, and pairs of pieces that were tested.
MEMO, PAIRS = 800_000, 1_000_000
#: ASCII characters that are neither letters, digits nor the space.
MARKS = "".join(c for c in map(chr, range(128)) if c != " " and not c.isalnum())
#: Bits of the table of pieces and of their beginnings.
PIECE, LONGER = 1, 2


def beginnings(pieces) -> dict[str, int]:
    """What each piece and each beginning of one is: a piece, the beginning of a longer one, or both."""
    out: dict[str, int] = {}
    for p in pieces:
        out[p] = out.get(p, 0) | PIECE
        for k in range(1, len(p)):
            out[p[:k]] = out.get(p[:k], 0) | LONGER
    return out


class Merges:
    """Backpointers of a BPE model."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.pairs, self.table = scores, {}, beginnings(scores)

    def merged(self, s: str) -> list[str]:
        parts, scores = list(s), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = scores.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str, piece: str) -> bool:
        got = self.pairs.get((before, piece))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def step(self, s: str, live: list[int], last: list[str], total: list[float]) -> list[int]:
        """Append the backpointer of the boundary behind the next character; starts that survive it."""
        i, table, pairs = len(last), self.table, self.pairs
        alive, best = [], None
        for j in live:
            t = s[j:i]
            kind = table.get(t, 0)
            if kind & LONGER:
                alive.append(j)
            if best is None and (kind & PIECE or i - j == 1):  # a character without a piece stands alone
                ok = pairs.get((last[j], t))
                if ok or ok is None and self.fits(last[j], t):
                    best = t
        last.append(best)
        total.append(0.0)
        return alive


class Sums:
    """Backpointers of a unigram model; characters outside it cost ``unknown``."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores, self.table = scores, beginnings(scores)
        self.unknown = min(scores.values(), default=0.0) - 10.0 if unknown is None else unknown

    def step(self, s: str, live: list[int], last: list[str], total: list[float]) -> list[int]:
        """Append the backpointer of the boundary behind the next character; starts that survive it."""
        i, table, scores = len(last), self.table, self.scores
        alive, best, piece = [], None, None
        for j in live:
            t = s[j:i]
            kind = table.get(t, 0)
            if kind & LONGER:
                alive.append(j)
            if kind & PIECE or i - j == 1:
                x = total[j] + (scores[t] if kind & PIECE else self.unknown)
                if best is None or x > best:
                    best, piece = x, t
        last.append(piece)
        total.append(best)
        return alive


class Stream:
    """Feed characters, get committed pieces.

    ``s``, ``last`` and ``total`` begin at the last trimmed boundary: the text,
    the backpointer of each boundary and the score of its best encoding.
    ``done`` is the boundary up to which pieces were handed out, ``live`` the
    starts that a longer piece may still use.
    """

    def __init__(self, rule, max_piece: int):
        self.rule, self.max_piece = rule, max_piece
        self.s, self.last, self.total = "", [""], [0.0]
        self.done, self.live, self.most = 0, [], 0

    def _back(self, i: int) -> list[str]:
        out = []
        while i > self.done:
            out.append(self.last[i])
            i -= len(self.last[i])
        return out[::-1]

    def _meet(self) -> int:
        """The boundary where the paths of all that survive meet."""
        ends = {len(self.last) - 1, *self.live}
        while len(ends) > 1:
            i = max(ends)
            ends.discard(i)
            ends.add(i - len(self.last[i]))
        return ends.pop()

    def _trim(self) -> None:
        d = self.done
        before, base = self.last[d], self.total[d]
        self.s, self.last, self.total = self.s[d:], self.last[d:], [x - base for x in self.total[d:]]
        self.last[0] = before  # the next piece must fit the one committed before
        self.live = [j - d for j in self.live]
        self.done = 0

    def feed(self, text: str) -> list[str]:
        out, window, step = [], self.max_piece, self.rule.step
        for k in range(0, len(text), window):
            self.s += text[k : k + window]
            s, last, total, live = self.s, self.last, self.total, self.live
            for i in range(len(last), len(s) + 1):
                live.append(i - 1)
                live = step(s, live, last, total)
                if not live:  # only this boundary survives
                    out += self._back(i)
                    self.done = i
            self.live = live
            if not live:  # as at the beginning, but for the piece in front
                self.s, self.last, self.total, self.done = "", [last[-1]], [0.0], 0
                continue
            self.most = max(self.most, len(s) - self.done)
            m = self._meet()
            if m > self.done:
                out += self._back(m)
                self.done = m
            if self.done:
                self._trim()
        return out

    def finish(self) -> list[str]:
        return self._back(len(self.last) - 1)


def fields(data: bytes):
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def model_type(model: bytes) -> int:
    """1 unigram, 2 BPE, 3 word, 4 character."""
    trainer = next((v for k, v in fields(model) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Codec:
    """Encoder and decoder of a model; the rule of its backpointers goes by the model's kind."""

    def __init__(self, model_file: str):
        import sentencepiece

        with open(model_file, "rb") as f:
            kind = model_type(f.read())
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.ids, scores, self.bytes_id = {}, {}, {}
        table = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_id[int(p[3:5], 16)] = i
                table.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                table.append(b"")
            elif sp.is_unknown(i):
                table.append(" ⁇ ".encode())
                self.unk = i
            else:
                self.ids[p], scores[p] = i, sp.get_score(i)
                table.append(p.replace(SPACE, " ").encode())
        self.kind = "<u2" if n <= 65536 else "<u4"
        self.table = table
        self.max_piece = max(map(len, self.ids))
        self.rule = Merges(scores) if kind == 2 else Sums(scores)
        self.memo = Stretches(self)
        # without byte pieces neighbouring unknown characters would be one id, wherever a text is fed from
        if not self.bytes_id:
            self.split = lambda t: [t]
        elif any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.split = lambda t: [t]
        else:
            # stretches may also end next to marks: all characters that pieces join to ASCII marks, directly or not
            marks, plain = set(MARKS), [set(p) - {SPACE} for p in self.ids]
            while more := set().union(*(x for x in plain if x & marks)) - marks:
                marks |= more
            held = re.escape("".join(sorted(marks)))
            apart = not any(x.isalpha() and x.isascii() for x in marks)
            # runs of spaces belong to the stretch behind them
            self.split = re.compile(f" *(?:[^{held} ]+|[{held}]+)| +" if apart else " *[^ ]+| +").findall

    def pieces(self, s: str) -> list[str]:
        """Pieces of a stretch, already written with U+2581."""
        stream = Stream(self.rule, self.max_piece)
        return stream.feed(s) + stream.finish()

    def packed(self, stretch: str) -> bytes:
        ids = []
        for x in self.pieces(stretch.replace(" ", SPACE)):
            i = self.ids.get(x)
            if i is not None:
                ids.append(i)
            elif self.bytes_id:
                ids += [self.bytes_id[b] for b in x.encode()]
            elif not ids or ids[-1] != self.unk:
                ids.append(self.unk)
        return np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        look = self.memo.__getitem__
        out = []
        for t in texts:
            t = t.replace(SPACE, " ")  # the same symbol to the model
            out.append(b"".join(map(look, self.split(" " + t))) if t else b"")
        return out

    def decode(self, packed: bytes) -> str:
        got = b"".join(map(self.table.__getitem__, np.frombuffer(packed, self.kind).tolist()))
        return got.decode("utf-8", "replace").removeprefix(" ")


class Stretches(dict):
    """Packed ids that the stream committed for stretches of texts; at most ``MEMO`` of bounded length are kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, stretch: str) -> bytes:
        got = self.codec.packed(stretch)
        if len(self) < MEMO and len(stretch) <= 4 * self.codec.max_piece:
            self[stretch] = got
        return got


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


_OUT = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, restored boolean"


def _digest(model_file: str):
    def run(batches):
        c = codec(model_file)
        for whole in batches:
            for b in slices(whole):
                texts = [t or "" for t in b.column(1).to_pylist()]
                packed = c.encode(texts)
                ids = [np.frombuffer(p, c.kind) for p in packed]
                back = [c.decode(p) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([x == t.replace(SPACE, " ") for x, t in zip(back, texts, strict=True)])],
                    names=["doc_id", "n_pieces", "ids_crc32", "text_crc32", "restored"],
                )

    return run


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the piece ids of every whole text; a null or empty text has none. Repeated rows stay."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(model_file)
        for whole in batches:
            for b in slices(whole):
                ids = [np.frombuffer(p, c.kind).astype(np.int32) for p in c.encode([t or "" for t in b.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); U+2581 in a text comes back as a space."""
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(model_file)
        for b in batches:
            texts = [c.decode(np.array(i or [], c.kind).tobytes()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: number and crc32 of its ids, crc32 of the decoded text, whether it equals the text."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_digest(model_file), _OUT)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
