"""Language ID with bit-sliced Bloom filters over character n-grams.

One table of ``2**SLOTS_LOG`` slots holds the Bloom filters of all languages:
bit l of a slot belongs to language l; a slot has as many machine words as the
languages need. An n-gram's slots, ANDed,
give the set of all languages whose filter holds it. For a document the bits
are counted by language; of n n-grams a filter with false-positive rate f
accepts n*f by chance, so (hits - n*f) / (1 - f) are counted as true. The
language with the most decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import materialise, ship, slices

#: n-grams are this many characters; a run of non-letters is one gap character.
N = 4
SLOTS_LOG, HASHES = 20, 2
#: About so many labelled documents of each language are learned from (chosen by hash), the bound of the fitted sample.
SAMPLE = 4000
#: An n-gram enters a filter if it is as frequent there as this share of its greatest frequency, and occurs so often.
SHARE, LEAST = 0.2, 3
#: Languages of one machine word.
WORD = 64
#: Bytes of text that a worker looks at together, so that its arrays stay small; a longer text is looked at whole.
SLICE = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of any plane to lower-cased letter, 0 for all else (marks, digits, tags, private use, surrogates)."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all n-grams, document of each, whether a document has a letter)."""
    code = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    low = _letters()[code]
    letter = low > 0
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # the first of a run of gaps stays
    keep[:1] = True
    low, owner = low[keep], owner[keep]
    if len(low) < N:
        return np.array([], np.uint64), np.array([], np.int32), has
    n = len(low) - N + 1
    h = np.zeros(n, np.uint64)
    for k in range(N):
        h = (h ^ low[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    # those that cross documents go
    one = owner[:n] == owner[N - 1 : N - 1 + n]
    return h[one], owner[:n][one], has


def slots(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOTS_LOG) - 1)
    return [((h >> np.uint64(3 + 21 * k)) & mask).astype(np.int64) for k in range(HASHES)]


def _counts(batches):
    for whole in batches:
        langs = np.array(whole.column(2).to_pylist(), dtype=object)
        for b, at in _with_offsets(whole):
            h, owner, _ = ngrams([t or "" for t in b.column(1).to_pylist()])
            own = langs[at : at + b.num_rows]
            for lang in sorted(set(own.tolist())):
                got, n = np.unique(h[(own == lang)[owner]], return_counts=True)
                if len(got):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])


def _with_offsets(whole):
    at = 0
    for b in slices(whole, SLICE):
        yield b, at
        at += b.num_rows


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, fallback: str | None):
        self.languages, self.table, self.fallback = languages, table, fallback
        self.chance = np.array([self._bit(table, i).mean() for i in range(len(languages))]) ** HASHES

    @staticmethod
    def _bit(words: np.ndarray, i: int) -> np.ndarray:
        """Language i's bit of each row of words."""
        w = words[:, i // WORD]
        return (w >> w.dtype.type(i % WORD)) & w.dtype.type(1)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        h, owner, has = ngrams(texts)
        m = None
        for s in slots(h):
            m = self.table[s] if m is None else m & self.table[s]
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        true = np.zeros((len(self.languages), len(texts)))
        for i, f in enumerate(self.chance):
            hits = np.bincount(owner, weights=self._bit(m, i), minlength=len(texts)) if len(h) else total
            true[i] = np.clip((hits - total * f) / max(1e-9, 1 - f), 0, None)
        if not len(self.languages):
            return ["und"] * len(texts), [0.0] * len(texts)
        best, whole = true.argmax(0), true.sum(0)
        score = np.where(whole > 0, true.max(0) / np.maximum(whole, 1e-9), 0.0)
        names = [("und" if not has[k] else self.languages[best[k]] if whole[k] > 0 else self.fallback) for k in range(len(texts))]
        return names, [float(x) if has[k] else 0.0 for k, x in enumerate(score)]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the rows given: text and language only; the id only chooses the sample.

    Rows with null text, language or id are left out; repeated rows count as
    often as they stand, other columns are not read, an empty table gives a model
    that knows no language. The driver receives one count for each language (a
    label set) and at most one row for each word of the table.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((1 << SLOTS_LOG, max(1, -(-len(languages) // WORD))), kind)
    if not languages:
        return Model([], table, None)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, sample / v))])
    chosen = rows.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6) < share[F.col("lang")]).select("id", "text", "lang")
    counts = chosen.mapInArrow(_counts, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "ngrams")
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    per = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))]) if totals else None
    if per is None:
        return Model(languages, table, max(languages, key=lambda x: sizes[x]))
    rate = counts.withColumn("rate", F.col("n") / per[F.col("lang")])
    top = rate.groupBy("h").agg(F.max("rate").alias("top"))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])[F.col("lang")]
    inside = rate.join(top, "h").where((F.col("rate") >= SHARE * F.col("top")) & (F.col("n") >= LEAST)).withColumn("i", place)
    inside = inside.select("h", F.floor(F.col("i") / WORD).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % WORD).alias("bit"))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", 3 + 21 * k).bitwiseAND((1 << SLOTS_LOG) - 1) for k in range(HASHES)]))
    words = inside.select(at.alias("slot"), "w", "bit").groupBy("slot", "w").agg(F.bit_or("bit").alias("word")).toPandas()
    table[words["slot"].to_numpy(), words["w"].to_numpy()] = words["word"].to_numpy().astype(np.int64).view(np.uint64).astype(kind)
    return Model(languages, table, max(languages, key=lambda x: (sizes[x], x)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) for every row: whole texts, null or letterless ones are ``und`` with score 0.

    Texts with letters but no n-gram of any language get the language with most
    documents, score 0; equal counts go to the first language by name. Repeated
    rows and null ids stay; of other columns only ``keep`` is read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most 2**SLOTS_LOG words

    def run(batches):
        for whole in batches:
            for b in slices(whole, SLICE):
                names, scores = shared.value.predict([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *b.columns[2:]], names=["doc_id", "lang_pred", "score", *b.schema.names[2:]])

    extra = keep or []
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[2:])
    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double" + (", " + kinds if kinds else ""))


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold() != 0))
    return predict(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
