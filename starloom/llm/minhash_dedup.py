"""MinHash near-dedup by an inverted join over signature coordinates.

1. A document's set is hashed in one pass: number of shingles, a 128-bit key of
   the whole set, and ``K`` MinHash coordinates. Equal sets are one class.
2. Classes are posted under their (coordinate, value) tokens. Two sets that
   agree in at least ``T`` coordinates share one of the ``m - T + 1`` rarest of
   the m tokens that a class shares with anybody (prefix filter, rarest first);
   the tokens behind are skipped, they only count towards the match.
3. Postings are merged in rounds. First every posting list is matched with one
   centre, twice with different centres, and confirmed links are joined to
   components; lists that lie in one component are then skipped, as no further
   link can change the result. What is left is matched in full between
   components: short lists many at a time, long ones in tiles of at most
   ``TILE`` classes, each pair only under its first common token.
4. Pairs with at least ``T`` equal coordinates are confirmed on the full sets.

Nothing is capped. At a true similarity of 0.75 a pair agrees in less than
T = 35 of K = 64 coordinates, and is missed, with a probability of 1.23e-4.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import components, hot_counted, hot_keys, materialise, salted_join, ship, slices

K, T, WORDS = 64, 35, 5
TILE, SHORT, GROUP = 2048, 256, 4096
#: Smallest hashes of a set that a posting carries. Sets of no more are compared whole; a pair with a longer one is dropped only where the
#: common ones are this many standard deviations below what the threshold gives (1e-9 of the links at the threshold, none well above it).
SKETCH, SIGMAS = 512, 6.0
#: Entries of a worker's memo of word hashes.
MEMO = 400_000


@lru_cache(maxsize=1)
def _seeds():
    g = np.random.Generator(np.random.PCG64(7))
    return g.integers(0, 2**64, K, dtype=np.uint64), g.integers(0, 2**64, K, dtype=np.uint64) | np.uint64(1)


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_memo: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; A-Z lower-cased, words between ASCII white space."""
    import xxhash

    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: only A-Z change, only ASCII white space splits
    need: set[bytes] = set()
    for w in words:
        need.update(w)
    new = [k for k in need if k not in _memo]
    fresh = {k: xxhash.xxh3_64_intdigest(k) for k in new}
    if len(_memo) + len(fresh) <= MEMO:
        _memo.update(fresh)
        look = _memo
    else:
        look = {k: _memo[k] for k in need if k in _memo} | fresh
    out = []
    for w in words:
        n = len(w)
        h = np.fromiter(map(look.__getitem__, w), np.uint64, n)
        if n >= WORDS:
            s = h[: n - WORDS + 1] * _FACTORS[0]
            for k in range(1, WORDS):
                s = s + h[k : n - WORDS + 1 + k] * _FACTORS[k]
            out.append(np.unique(_mix(s)))
        elif n:
            out.append(_mix((h * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(h)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit MinHash values of sets that aren't empty, one row a set."""
    a, b = _seeds()
    whole = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), K), np.int32)
    for k in range(K):
        v = np.minimum.reduceat((whole ^ a[k]) * b[k], at)
        out[:, k] = (v >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _profiles(batches):
    for whole in batches:
        for b in slices(whole):
            sets = shingle_sets([t or "" for t in b.column(1).to_pylist()])
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [None] * len(sets)
            key = [(None, None)] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]) if full else [], strict=True):
                sig[i] = row
                key[i] = tuple(int(x) for x in np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"],
            )


def _full_sets(batches):
    for whole in batches:
        for b in slices(whole):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets([t or "" for t in b.column(1).to_pylist()])], pa.binary())], names=["doc_id", "s"])


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _sketches(batches):
    """Upper halves of the smallest hashes of each set; sets are sorted."""
    for whole in batches:
        for b in slices(whole):
            sets = shingle_sets([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())],
                names=["rep", "size", "sketch"],
            )


def _compare(x: int, y: np.ndarray, size: np.ndarray, sketch: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of ``x`` with each of ``y``: those that the sketches prove, and those that they leave open."""
    mine, flat = sketch[x], np.concatenate([sketch[i] for i in y])
    lengths = np.array([len(sketch[i]) for i in y])
    at = np.cumsum(lengths) - lengths
    # both sketches hold all hashes up to this one
    most = np.iinfo(np.uint32).max
    limit = np.where(size[y] > SKETCH, flat[at + lengths - 1], most)
    limit = np.minimum(limit, mine[-1] if size[x] > SKETCH else most)
    within = flat <= np.repeat(limit, lengths)
    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    both = np.add.reduceat((hit & within).astype(np.int64), at)
    union = np.searchsorted(mine, limit, "right") + np.add.reduceat(within.astype(np.int64), at) - both
    whole = (size[y] <= SKETCH) & (size[x] <= SKETCH)
    p = percent / 100
    # halves of hashes may collide, so two common hashes fewer must still do
    proven = whole & (100 * (both - 2) >= percent * (union + 2))
    possible = np.where(whole, 100 * both >= percent * union, both >= (p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(union, 1))) * union)
    return y[proven], y[possible & ~proven]


def _tile_pairs(percent: int):
    """Pairs with at least T equal coordinates, under their first common token only, that could join two components."""

    def run(pdf):
        import pandas as pd

        out = []
        sig = np.stack(pdf["sig"].to_numpy()) if len(pdf) else np.empty((0, K), np.int32)
        pre = (pdf["pre"].to_numpy().astype(np.int64)[:, None] >> np.arange(K)) & 1 == 1  # coordinates of the prefix
        rep, label, side, size = pdf["rep"].to_numpy(), pdf["c"].to_numpy().copy(), pdf["side"].to_numpy(), pdf["size"].to_numpy()
        sketch = [np.frombuffer(b, np.uint32) for b in pdf["sketch"]]
        for (token, i, j), at in pdf.groupby(["token", "i", "j"]).indices.items():
            left, right = at[side[at] != 1], at[side[at] != 0]
            for x in left.tolist():
                y = right[(label[right] != label[x]) & ((rep[right] > rep[x]) | (i != j))]
                y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
                if not len(y):
                    continue
                same = sig[y] == sig[x]
                first = (same & pre[y] & pre[x]).argmax(1) == token >> 32
                y = y[first & (same.sum(1) >= T)]
                if not len(y):
                    continue
                proven, open_ = _compare(x, y, size, sketch, percent)
                for k in proven.tolist():
                    if label[k] != label[x]:
                        out.append((rep[x], rep[k]))
                        label[label == label[k]] = label[x]
                out += [(rep[x], rep[k]) for k in open_.tolist() if label[k] != label[x]]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": found.min(1), "b": found.max(1)})

    return run


class Linker:
    """One run of the join; every table is written to the shared folder."""

    def __init__(self, docs: DataFrame, percent: int, id_col: str, text_col: str):
        ship(docs.sparkSession)
        self.percent = percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.profiles = materialise(self.docs.mapInArrow(_profiles, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"), "profiles")
        full = self.profiles.where("n_shingles > 0 AND doc_id IS NOT NULL")
        self.repeated = materialise(full.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        self.classes = materialise(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("n")), "classes")

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(rep, token) and (rep, pre): the prefixes of classes that can have a partner."""
        tokens = self.classes.select("rep", F.posexplode("sig").alias("k", "v"))
        tokens = tokens.select("rep", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
        shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        # a frequent token's rows are salted wherever they look something up
        mine = salted_join(tokens, shared, ["token"], columns=["rep"], hot=hot_counted(shared, ["token"], "n")).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("all"))
        pre = mine.where(F.size("all") >= T).select("rep", F.slice(F.col("all.token"), 1, F.size("all") - T + 1).alias("pre"))
        pre = materialise(pre, "prefixes")
        return pre.select("rep", F.explode("pre").alias("token")), pre

    def matched(self, pairs: DataFrame) -> DataFrame:
        """Pairs with at least T equal coordinates."""
        pairs = materialise(pairs.distinct(), "candidates")
        sig = self.classes.select("rep", "sig").join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
        sig = materialise(sig, "pair-signatures")
        got = self.both(pairs, sig, "sig", "ga", "gb")
        equal = F.aggregate(F.zip_with("ga", "gb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return got.where(equal >= T).select("a", "b")

    @staticmethod
    def both(pairs: DataFrame, table: DataFrame, value: str, left: str, right: str) -> DataFrame:
        """Pairs with a value of each end; the centre of many pairs is salted."""
        hot = hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("rep")), ["rep"])
        x = pairs
        for end, other, name in (("a", "b", left), ("b", "a", right)):
            mine = table.select(F.col("rep").alias(end), F.col(value).alias(name))
            x = salted_join(x, mine, [end], columns=[other], hot=None if hot is None else hot.withColumnRenamed("rep", end))
        return x

    def once(self, rows: DataFrame, key: str) -> DataFrame:
        """Each text of an id once; only ids that documents repeat are shuffled."""
        many = self.repeated.select(F.col("doc_id").alias(key))
        return rows.join(many, key, "left_anti").unionByName(rows.join(many, key, "left_semi").dropDuplicates([key, "text"]))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = self.once(self.docs.join(ids, "doc_id", "left_semi"), "doc_id").mapInArrow(_full_sets, "doc_id long, s binary")
        sets = materialise(sets.where("length(s) > 0"), "sets")
        x = self.both(pairs, sets.withColumnRenamed("doc_id", "rep"), "s", "sa", "sb")
        return materialise(x.mapInArrow(_confirm(self.percent), "a long, b long"), "links")

    def labelled(self, posts: DataFrame, links: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Postings with components, of lists that hold several."""
        comp = materialise(components(links).select(F.col("node").alias("rep"), F.col("component").alias("c")), "components")
        p = posts.join(comp, "rep", "left").select("rep", "token", F.coalesce("c", "rep").alias("c"))
        open_ = p.groupBy("token").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token", "n")
        return comp, materialise(salted_join(p, open_, ["token"], columns=["rep"], hot=hot), "open")

    def star(self, posts: DataFrame, seed: int | None, hot: DataFrame | None) -> DataFrame:
        order = F.col("rep") if seed is None else F.struct(F.xxhash64("rep", F.lit(seed)).alias("o"), F.col("rep").alias("rep"))
        centre = posts.groupBy("token").agg(F.min(order).alias("m"))
        centre = centre.select("token", (F.col("m") if seed is None else F.col("m.rep")).alias("centre"))
        return salted_join(posts, centre, ["token"], columns=["rep"], hot=hot).where("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))

    def rest(self, open_: DataFrame, prefixes: DataFrame) -> DataFrame:
        """Matches between components: short lists many at a time, long ones in pairs of tiles."""
        tiles = F.ceil(F.col("n") / TILE).cast("int")
        dealt = open_.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), side.alias("side"), "rep", "c", "n")
        # a posting carries its signature, its sketch and a bit for each coordinate of its prefix
        bits = prefixes.select("rep", F.expr("aggregate(pre, 0L, (s, t) -> s | shiftleft(1L, int(shiftright(t, 32))))").alias("pre"))
        held = materialise(open_.select("rep").distinct(), "held")
        sketches = self.once(self.docs.withColumnRenamed("doc_id", "rep").join(held, "rep", "left_semi"), "rep").mapInArrow(_sketches, "rep long, size long, sketch binary")
        carried = self.classes.select("rep", "sig").join(held, "rep", "left_semi").join(bits, "rep").join(sketches.where("size > 0"), "rep")
        dealt = dealt.join(materialise(carried, "carried"), "rep")
        bins = max(1, open_.count() // GROUP)
        bin_ = F.when(F.col("n") <= SHORT, F.pmod(F.xxhash64("token"), F.lit(bins))).otherwise(F.xxhash64("token", "i", "j"))
        return dealt.withColumn("bin", bin_).groupBy("bin").applyInPandas(_tile_pairs(self.percent), "a long, b long")

    def components(self) -> DataFrame:
        """(rep, c): classes with links and their component."""
        posts, prefixes = self.postings()
        hot = hot_keys(posts, ["token"])
        links = self.confirmed(self.matched(self.star(posts, None, hot)))
        comp, open_ = self.labelled(posts, links, hot)
        if open_.isEmpty():
            return comp
        links = links.unionByName(self.confirmed(self.matched(self.star(open_, 1, hot).join(links, ["a", "b"], "left_anti"))))
        comp, open_ = self.labelled(posts, links, hot)
        if open_.isEmpty():
            return comp
        links = links.unionByName(self.confirmed(self.rest(open_, prefixes).distinct()))
        return components(links).select(F.col("node").alias("rep"), F.col("component").alias("c"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked where 100 * common >= ``percent`` * united shingles;
    the component is the smallest id reachable. Null and empty texts have an
    empty set and link with nothing; null ids link with nothing and have a null
    component. Texts are read whole, however long; other columns are not read.
    Equal rows are equal sets of one id. Rows of one id with
    different texts are one node, whose links are those of either set that
    stands for its class. ``percent`` below 75 is refused, T is fitted to it.
    """
    if percent < 75:
        raise ValueError("the match threshold T holds for 75 % and more")
    x = Linker(docs, percent, id_col, text_col)
    comp = x.components()
    classes = x.classes.select("k1", "k2", "rep").join(comp, "rep", "left").select("k1", "k2", F.coalesce("c", "rep").alias("c"))
    # a large group of equal sets is one class with many rows
    out = salted_join(x.profiles.select("doc_id", "n_shingles", "k1", "k2"), classes, ["k1", "k2"], "left", columns=["doc_id"], hot=hot_counted(x.classes, ["k1", "k2"], "n"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in SQL for DuckDB, by exact sets.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
k AS (SELECT g, dense_rank() OVER (ORDER BY g) AS g_no FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
t AS (SELECT doc_id, g_no FROM s JOIN k USING (g)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g_no = b.g_no AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
