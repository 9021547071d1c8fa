"""Token-ID output as a content-addressed store.

Layout below one path, all Parquet:

* ``chunks``    hash (16 bytes, the name), width, n_ids, data: each distinct chunk once
* ``recipes``   doc_id, row_id, seq, hash, n_ids: which chunks make up a document, ascending doc_id
* ``manifest``  doc_id, row_id, start, n_tokens, n_chunks, root: offsets and Merkle roots, ascending doc_id

A rolling hash over the last ``WINDOW`` ids decides where chunks end, so equal
passages give equal chunks wherever they stand. A document's root is the Merkle
root over its chunk names; a reader recomputes chunk names and roots.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from starloom.llm.common import discard, hot_keys, materialise, salted_join, scratch, ship, slices

WINDOW = 16
#: Chunks hold 64 to 1024 ids, about 64 + 256 on average.
LEAST, MOST, MASK = 64, 1024, np.uint32(255 << 20)
#: Entries of a worker's memo of encoded parts of texts; what is beyond them is encoded anew wherever it stands.
MEMO = 1_000_000
#: Chunk names that a task remembers so as to pass on their bytes once; what is beyond them is only found later.
SEEN = 500_000

_SPACE_BEFORE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
# Characters whose class the pre-tokeniser surely shares: letters of old blocks, ASCII digits, ASCII marks but the apostrophe.
_L, _D, _M = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f", "0-9", r"!\"#$%&()*+,./:;<=>?@\[\\\]\^_`{|}~\-"
_NEXT = f"(?![^{_L}{_D}{_M} \\n])"
#: Whole pre-tokens of a text: runs of one class up to a known character or the end, line feeds before one; else all up to the next space.
_PARTS = re.compile(f" ?[{_L}]++{_NEXT}| ?[{_M}]++{_NEXT}| ?[{_D}]++{_NEXT}|\\n(?=[{_L}{_D}{_M}])|\\n+(?=\\n[{_L}{_D}{_M}])|\\n+\\Z| ?[^ ]+| ")
#: Parts that are one pre-token and may go to the model directly.
_ONE = re.compile(f" ?(?:[{_L}]+|[{_M}]+|[{_D}]+)")


def _alphabet() -> dict[int, str]:
    """Byte to the character that stands for it in a byte-level vocabulary: printable ones themselves, the others from U+0100 on."""
    out = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - 188))
    return out


class Parts(dict):
    """Packed ids of parts of texts, encoded when first asked for; at most ``MEMO`` are kept."""

    def __init__(self, tokenizer, kind: str, added: list[str]):
        super().__init__()
        self.added = added
        self.tokenizer, self.model, self.letters, self.code = tokenizer, tokenizer.model, _alphabet(), "I" if kind == "<u4" else "H"
        self.space = self.letters[32]

    def __missing__(self, part: str) -> bytes:
        if _ONE.fullmatch(part) and not any(a in part for a in self.added):
            letters = part.replace(" ", self.space) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        else:
            got = array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self) < MEMO:
            self[part] = got
        return got


class WordMemo:
    """Ids of whole texts through ids of their pre-tokens.

    A byte-level pre-tokeniser cuts between letters, digits and marks and in
    front of every space that follows a non-space character, so the parts may
    be encoded alone; those that are one pre-token for sure go to the library's
    model, others to its whole encoder. Frequent parts are encoded once for a
    worker. Texts with runs of spaces, a space at the end or an added token are
    cut at spaces first. Tokenizers of other kinds, and texts with an
    added token that holds a space, encode whole texts.
    """

    def __init__(self, tokenizer, wide: bool):
        self.tokenizer, self.kind = tokenizer, "<u4" if wide else "<u2"
        said = json.loads(tokenizer.to_str())
        pre, model = said.get("pre_tokenizer") or {}, said["model"]
        odd = any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout"))
        self.whole = bool(said.get("normalizer")) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or odd
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # added tokens are matched before all else: words that hold one aren't cut, nor texts that hold one with a space
        self.added, self.spaced = [a for a in added if " " not in a], [a for a in added if " " in a]
        self.memo = Parts(tokenizer, self.kind, added)

    def parts(self, text: str) -> list[str]:
        if self.spaced and any(a in text for a in self.spaced):
            return [text]
        if "  " not in text and text[-1:] != " " and not any(a in text for a in self.added):
            return _PARTS.findall(text)
        out = []
        for p in _CUT.split(text):
            if _SPACE_BEFORE.search(p) or any(a in p for a in self.added):
                out.append(p)
            else:
                out += _PARTS.findall(p)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        look = self.memo.__getitem__
        return [b"".join(map(look, self.parts(t))) for t in texts]


@lru_cache(maxsize=4)
def _worker(path: str) -> WordMemo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return WordMemo(t, t.get_vocab_size() > 65536)


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 65536, dtype=np.uint32)


def _marks(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the rolling hash allows a cut; those with less than ``LEAST`` ids of a stream in front aren't used, so streams may stand in one array."""
    h, width = _gear()[ids & 0xFFFF], 1
    if ids.dtype.itemsize > 2:
        h = h + (ids >> 16).astype(np.uint32) * np.uint32(0x9E3779B1)
    while width < WINDOW:  # h[i] = sum of g[i-k] << k over the window, by doubling
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero((h & MASK) == 0) + 1


def _ends(marks: list[int], at: int, n: int) -> list[int]:
    """Ends of the chunks of the stream from ``at`` to ``n``."""
    ends = []
    for c in marks:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return _ends(_marks(ids).tolist(), 0, len(ids))


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(names: list[bytes]) -> bytes:
    """Root over chunk names; an odd node moves up alone, leaves and nodes are tagged apart."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in names]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b""


_STAGED = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("seq", pa.int32()), ("hash", pa.binary()), ("n_ids", pa.int32()), ("width", pa.int32()), ("n_tokens", pa.int64()), ("n_chunks", pa.int32()), ("root", pa.binary()), ("data", pa.binary())])
_STAGED_SPARK = "doc_id long, row_id long, seq int, hash binary, n_ids int, width int, n_tokens long, n_chunks int, root binary, data binary"


def _encoder(path: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext

        memo, row, seen = _worker(path), TaskContext.get().partitionId() << 33, set()
        size = 4 if memo.kind == "<u4" else 2
        end = b"" if end_id is None else np.array([end_id], memo.kind).tobytes()
        for whole in batches:
            for b in slices(whole):
                streams = [s + end for s in memo.encode([t or "" for t in b.column(1).to_pylist()])]
                flat = b"".join(streams)
                n = np.fromiter(map(len, streams), np.int64, len(streams)) // size
                stop = np.cumsum(n)
                marks = _marks(np.frombuffer(flat, memo.kind))
                # marks up to a stream's own last id
                cut = np.searchsorted(marks, np.concatenate([[0], stop]), "right").tolist()
                marks, ends, counts = marks.tolist(), [], []
                for i, (at, to) in enumerate(zip((stop - n).tolist(), stop.tolist(), strict=True)):
                    mine = _ends(marks[cut[i] : cut[i + 1]], at, to) or [at]  # no ids: one row without a chunk
                    ends += mine
                    counts.append(len(mine))
                counts, ends = np.array(counts, np.int64), np.array(ends, np.int64)
                first = np.cumsum(counts) - counts
                starts = np.concatenate([[0], ends[:-1]])
                names, data = [], []
                for a, z in zip((starts * size).tolist(), (ends * size).tolist(), strict=True):
                    p = flat[a:z]
                    name = name_of(p) if p else b""
                    new = bool(p) and name not in seen
                    if new and len(seen) < SEEN:
                        seen.add(name)
                    names.append(name)
                    data.append(p if new else None)
                roots = [None] * len(names)
                for a, k, m in zip(first.tolist(), counts.tolist(), n.tolist(), strict=True):
                    roots[a] = merkle_root(names[a : a + k] if m else [])
                owner = np.repeat(np.arange(len(n)), counts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner)), pa.array(row + owner), pa.array((np.arange(len(names)) - first[owner]).astype(np.int32)), pa.array(names, pa.binary()), pa.array((ends - starts).astype(np.int32)), pa.array(np.full(len(names), size, np.int32)), pa.array(n[owner]), pa.array(np.where(n > 0, counts, 0)[owner].astype(np.int32)), pa.array(roots, pa.binary()), pa.array(data, pa.binary())],
                    schema=_STAGED,
                )
                row += len(n)

    return run


def _running(batches):
    from pyspark import TaskContext

    pid, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = np.asarray(b.column("n_tokens"), dtype=np.int64)
        local = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), pid, np.int64)), pa.array(local)], names=[*b.schema.names, "part", "local_start"])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store.

    Null texts count as empty; with an end id they still hold that id. Null ids
    sort first; repeated ids are separate documents, told apart by row_id.
    Other columns are not read. An empty table gives empty files. Recipes and
    manifest are in ascending order within a file and from one to the next.
    """
    spark = docs.sparkSession
    ship(spark)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged_at, running_at = scratch(spark, "staged"), scratch(spark, "running")
    s = materialise(cols.mapInArrow(_encoder(tokenizer, end_id), _STAGED_SPARK), "staged", staged_at)
    # a task passes on a chunk's bytes once, so a name comes about once a task; its first row stays
    earlier = F.lag(F.lit(1)).over(Window.partitionBy("hash").orderBy("row_id", "seq"))
    chunks = s.where("data IS NOT NULL").select("hash", "width", "n_ids", "data", earlier.alias("_earlier"))
    _store(chunks.where("_earlier IS NULL").drop("_earlier"), f"{path}/chunks")
    _store(s.where("n_chunks > 0").select("doc_id", "row_id", "seq", "hash", "n_ids").repartitionByRange("doc_id", "row_id", "seq").sortWithinPartitions("doc_id", "row_id", "seq"), f"{path}/recipes")
    d = s.where("seq = 0").select("doc_id", "row_id", "n_tokens", "n_chunks", "root").repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    d = materialise(d.mapInArrow(_running, T.StructType([*d.schema.fields, T.StructField("part", T.LongType()), T.StructField("local_start", T.LongType())])), "running", running_at)
    # One row for each partition, so this window stays small whatever the input.
    sums = d.groupBy("part").agg(F.sum("n_tokens").alias("s")).select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    m = d.join(F.broadcast(sums), "part").select("doc_id", "row_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "n_chunks", "root")
    # reading packs files by size, so the order is made last
    _store(m.repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id"), f"{path}/manifest")
    discard(spark, staged_at)
    discard(spark, running_at)


def _store(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)


@lru_cache(maxsize=64)
def _zeros(log: int) -> np.ndarray:
    """The crc32 state after ``2**log`` zero bytes, for each value of each byte of the state before."""

    def times(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = (0xEDB88320, *(1 << i for i in range(31)))  # one zero bit
    for _ in range(3 + log):
        m = tuple(times(m, x) for x in m)
    return np.array([[times(m, x << 8 * k) for x in range(256)] for k in range(4)], np.uint32)


def crc_behind(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds, by exclusive or, to that of the bytes that end ``n_bytes`` behind its own."""
    crc, log = crc.astype(np.uint32), 0
    while (left := n_bytes >> log).any():
        at = np.flatnonzero(left & 1)
        if len(at):
            t, c = _zeros(log), crc[at]
            crc[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        log += 1
    return crc


_CHECKED = "hash binary, crc long, ok boolean"


def _checked(batches):
    for b in batches:
        names, data = b.column("hash").to_pylist(), b.column("data").to_pylist()
        width, n = b.column("width").to_numpy(), b.column("n_ids").to_numpy()
        size = np.fromiter(map(len, data), np.int64, len(data))
        narrow = np.frombuffer(b"".join([d for d, w in zip(data, width.tolist(), strict=True) if w == 2]), "<u2").astype("<u4").data
        crc, ok, at = [], [], 0
        for name, w, d, k, good in zip(names, width.tolist(), data, (size // 2).tolist(), (size == width * n).tolist(), strict=True):
            crc.append(zlib.crc32(narrow[at : at + k] if w == 2 else d))
            at += k if w == 2 else 0
            ok.append(good and name_of(d) == name)
        yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(crc, pa.int64()), pa.array(ok)], names=["hash", "crc", "ok"])


def _folded(batches):
    for b in batches:
        lists, roots = b.column("parts"), b.column("root").to_pylist()
        counts = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
        flat, owner = lists.flatten(), np.repeat(np.arange(len(counts)), counts)
        column = {k: flat.field(k) for k in ("seq", "n_ids", "crc", "ok")}
        column = {k: v.to_numpy(zero_copy_only=False) for k, v in column.items()}
        order = np.lexsort((column["seq"], owner))
        hashes = flat.field("hash").to_pylist()
        names = [hashes[i] for i in order.tolist()]
        n = column["n_ids"][order].astype(np.int64)
        stop = np.cumsum(n)
        first = np.cumsum(counts) - counts
        total = np.bincount(owner, weights=n, minlength=len(counts)).astype(np.int64)
        ends = np.cumsum(total)
        crc, good = np.zeros(len(counts), np.int64), np.ones(len(counts), bool)
        held = np.flatnonzero(counts)
        if len(held):
            crc[held] = np.bitwise_xor.reduceat(crc_behind(column["crc"][order].astype(np.int64), 4 * (ends[owner] - stop)), first[held])
            good[held] = np.logical_and.reduceat(column["ok"][order].astype(bool), first[held])
        good &= (counts == b.column("n_chunks").to_numpy()) & (total == b.column("n_tokens").to_numpy())
        ok = [bool(g) and merkle_root(names[a : a + k]) == (root or b"") for g, a, k, root in zip(good, first.tolist(), counts.tolist(), roots, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc), b.column("n_chunks"), pa.array(ok)], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, from the files: offsets, crc32 of its ids, and whether names and root hold.

    Chunk bytes stay where they are read: their crc32 are joined to the recipes
    and folded in order, which equals the crc32 of the joined bytes. A chunk
    that very many recipes name is salted. Null and repeated ids have a row for
    each document, an empty store gives none.
    """
    ship(spark)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_checked, _CHECKED)
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = salted_join(recipes, chunks, ["hash"], hot=hot_keys(recipes, ["hash"]))
    per = parts.groupBy("row_id").agg(F.collect_list(F.struct("seq", "hash", "n_ids", "crc", "ok")).alias("parts"))
    m = spark.read.parquet(f"{path}/manifest").join(per, "row_id", "left")
    return m.mapInArrow(_folded, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, verified boolean")


def read_documents(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """doc_id, ids of documents (those that fulfil ``where`` on the manifest), rebuilt from chunks."""
    ship(spark)
    m = spark.read.parquet(f"{path}/manifest")
    m = m.where(where) if where else m
    r = spark.read.parquet(f"{path}/recipes").join(m.select("row_id"), "row_id", "left_semi")
    p = salted_join(r, spark.read.parquet(f"{path}/chunks").select("hash", "width", "data"), ["hash"], hot=hot_keys(r, ["hash"]))
    per = p.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("seq", "width", "data"))).alias("parts"))

    def ids(batches):
        for b in batches:
            out = [np.concatenate([np.frombuffer(x["data"], "<u4" if x["width"] == 4 else "<u2") for x in ps]).astype(np.int64) if ps else np.array([], np.int64) for ps in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return m.select("doc_id", "row_id").join(per, "row_id", "left").mapInArrow(ids, "doc_id long, ids array<long>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digest(spark, path)
