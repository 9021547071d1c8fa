"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. The rows of a
pivot are cut at quantiles of that distance into annuli. For a query at distance
d from the pivot, a vector in an annulus [lo, hi] is at least
max(0, lo - d, d - hi) away (triangle inequality), and 2 <q, v> = |q|^2 + |v|^2 -
|q - v|^2 bounds its score by the annulus' largest norm. A first wave reads the
blocks of each query's best-bounded annulus and gives it its k-th best score;
the second wave goes through the annuli in the order of their bounds and stops
at the first bound below that score.

Pivots grow with the root of the table up to ``PIVOTS``, so the catalogue of
annuli holds at most PIVOTS * ANNULI rows and may be sent to every task. Blocks
hold about ``BLOCK`` vectors, queries come in blocks of about ``QUERIES``; in
the second wave a block of queries meets each block of vectors that any of its
queries wants once, as packed whole numbers, and only wanting queries are
scored. No task holds more than one of each.

How much the bounds skip depends on the data: among clustered vectors most
annuli, among vectors without clusters in many dimensions hardly any, as all
distances are alike there; then the search compares everything, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.llm.common import materialise, scratch, ship

#: Most pivots and annuli a pivot, about so many vectors and queries a block.
PIVOTS, ANNULI, BLOCK, QUERIES = 256, 8, 4096, 1024
#: Rows that pivots and quantiles are fitted on; every row is indexed.
SAMPLE = 4096


def usable(vec: str) -> Column:
    """No null vector, no null, NaN or infinite component."""
    c = F.col(vec)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def whole_numbers(vec: str, scale: int = 1024) -> Column:
    return F.transform(F.col(vec), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _stack(values) -> np.ndarray:
    """Rows as one matrix; shorter ones are padded with zeros."""
    n = max(map(len, values))
    if all(len(v) == n for v in values):
        return np.stack([np.asarray(v, np.int64) for v in values])
    out = np.zeros((len(values), n), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _same(a: np.ndarray, dim: int) -> np.ndarray:
    return a[:, :dim] if a.shape[1] >= dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; in double precision where no sum can leave 2**53."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if d and float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * d < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _norms(v: np.ndarray) -> np.ndarray:
    f = v.astype(np.float64)
    return (f * f).sum(1)


def bounds(q: np.ndarray, pivots: np.ndarray, c: pd.DataFrame) -> np.ndarray:
    """No vector of an annulus scores more against a query (one row each); rounded up against rounding errors."""
    d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ pivots.T + (pivots**2).sum(1)[None, :]))[:, c["pivot"].to_numpy()]
    least = np.maximum(0, np.maximum(c["lo"].to_numpy() - d, d - c["hi"].to_numpy()) - 1e-3)
    return ((q**2).sum(1)[:, None] + c["norm2"].to_numpy() - least**2) / 2 + 1


class PivotIndex:
    """Index of (vec_id, v): whole-number vectors. Built once, searched by blocks of queries."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        ship(self.spark)
        sample = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]  # a fixed number of rows
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        self.rows_n, self.dim = size["n"], size["dim"] or 0
        self.empty = not sample
        if self.empty:
            return
        # packed as narrow as the largest component allows
        self.kind = next(k for k in ("<i2", "<i4", "<i8") if size["most"] <= np.iinfo(k).max or k == "<i8")
        s = _same(_stack(sample), self.dim).astype(np.float64)
        self.pivots = self._spread(s, int(min(PIVOTS, max(32, np.sqrt(self.rows_n) / 4))))
        near, dist = self._nearest(self.pivots, s)
        edges = [np.unique(np.quantile(dist[near == p], np.linspace(0, 1, ANNULI + 1)[1:-1])) if (near == p).any() else np.array([]) for p in range(len(self.pivots))]
        pivots, dim, kind, nearest = self.pivots, self.dim, self.kind, self._nearest

        def keyed(batches):
            for pdf in batches:
                if len(pdf):
                    v = _same(_stack(pdf["v"].tolist()), dim)
                    p, d = nearest(pivots, v.astype(np.float64))
                    a = np.array([np.searchsorted(edges[i], x, "right") for i, x in zip(p, d, strict=True)], np.int32)
                    yield pd.DataFrame({"vec_id": pdf["vec_id"], "pivot": p.astype(np.int32), "annulus": a, "dist": d, "norm2": _norms(v), "v": [x.tobytes() for x in v.astype(kind)]})

        self.rows = materialise(vectors.mapInPandas(keyed, "vec_id long, pivot int, annulus int, dist double, norm2 double, v binary"), "pivot-index")
        cat = self.rows.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm2").alias("norm2"))
        self.catalogue = cat.toPandas().sort_values(["pivot", "annulus"], ignore_index=True)  # at most PIVOTS * ANNULI rows
        self.catalogue["blocks"] = np.maximum(1, -(-self.catalogue["n"] // BLOCK)).astype(np.int32)

    @staticmethod
    def _spread(s: np.ndarray, n: int) -> np.ndarray:
        """Pivots far from each other, greedily."""
        chosen = [0]
        far = ((s - s[0]) ** 2).sum(1)
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((s - s[chosen[-1]]) ** 2).sum(1))
        return s[chosen]

    @staticmethod
    def _nearest(pivots: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = (v**2).sum(1)[:, None] - 2 * v @ pivots.T + (pivots**2).sum(1)[None, :]
        p = d2.argmin(1)
        return p, np.sqrt(((v - pivots[p]) ** 2).sum(1))

    def _met(self, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """Best rows of each visited block for the queries that visit it.

        ``queries`` are (qb, query_id, q, floor, ub) rows or packed blocks of
        them, joined to visits by ``qb``; visits are (qb, pivot, annulus, block).
        """
        keys = ["pivot", "annulus", "block", "qb"]
        c = self.spark.createDataFrame(self.catalogue[["pivot", "annulus", "blocks"]])
        rows = self.rows.select("vec_id", "v", "pivot", "annulus").join(F.broadcast(c), ["pivot", "annulus"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        rows = rows.join(visits.select(*keys).distinct(), ["pivot", "annulus", "block"])
        dim, kind, pivots, cat = self.dim, self.kind, self.pivots, self.catalogue

        def unpack(packed) -> np.ndarray:
            return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.int64) if dim else np.zeros((len(packed), 0), np.int64)

        def best(key, left, right):
            found = []
            if len(left) and len(right):
                q, ids, floor = unpack(left["q"]), np.concatenate([np.frombuffer(x, "<i8") for x in left["query_id"]]), np.concatenate([np.frombuffer(x, "<i8") for x in left["floor"]])
                here = cat[(cat["pivot"] == key[0]) & (cat["annulus"] == key[1])]
                want = bounds(q.astype(np.float64), pivots, here)[:, 0] >= floor
                q, ids, floor = q[want], ids[want], floor[want]
                own = right["vec_id"].to_numpy()
                s = _scores(q, unpack(right["v"]))
                for i, query in enumerate(ids):
                    at = np.flatnonzero((s[i] >= floor[i]) & (own != query))
                    if len(at) > k:
                        edge = np.partition(s[i][at], len(at) - k)[len(at) - k]
                        at = at[s[i][at] >= edge]
                    at = at[np.lexsort((own[at], -s[i][at]))][:k]
                    found.append((np.full(len(at), query), own[at], s[i][at]))
            parts = [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [np.array([], np.int64)] * 3
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

        left = visits.join(queries, "qb") if "query_id" not in visits.columns else visits
        return left.groupBy(*keys).cogroup(rows.select("vec_id", "v", *[F.col(c).alias(c) for c in keys]).groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score long")

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score) for (query_id, q); a query's own id is no answer."""
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        n = queries.count()
        blocks = max(1, -(-n // QUERIES))
        q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        dim, kind, cat, pivots = self.dim, self.kind, self.catalogue, self.pivots
        sizes, pv, an, bl = (cat[c].to_numpy() for c in ("n", "pivot", "annulus", "blocks"))

        def nearest_annuli(batches):
            """The best-bounded annuli of each query, as many as hold k others."""
            for pdf in batches:
                if not len(pdf):
                    continue
                v = _same(_stack(pdf["q"].tolist()), dim)
                ub = bounds(v.astype(np.float64), pivots, cat)
                take = []
                for i in range(len(pdf)):
                    order = np.argsort(-ub[i], kind="stable")
                    take.append(order[: int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1])
                at, o = np.repeat(np.arange(len(pdf)), [len(x) for x in take]), np.concatenate(take)
                packed = [x.tobytes() for x in v.astype(kind)]
                low = np.array([-(2**62)], "<i8").tobytes()
                yield pd.DataFrame({"qb": pdf["qb"].to_numpy()[at], "query_id": [np.array([x], "<i8").tobytes() for x in pdf["query_id"].to_numpy()[at]], "q": [packed[i] for i in at], "floor": low, "pivot": pv[o], "annulus": an[o], "blocks": bl[o]})

        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        first = q.mapInPandas(nearest_annuli, "qb int, query_id binary, q binary, floor binary, pivot int, annulus int, blocks int")
        first = materialise(first.select("qb", "query_id", "q", "floor", "pivot", "annulus", block), "first-visits")
        first = materialise(self._top(self._met(None, first, k), k), "first-wave")
        floor = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("f"))
        q = q.join(floor, "query_id", "left").select("query_id", "q", F.coalesce("f", F.lit(-(2**62))).alias("floor"), "qb")

        def packed_block(pdf):
            v = _same(_stack(pdf["q"].tolist()), dim)
            return pd.DataFrame({"qb": [int(pdf["qb"].iloc[0])], "query_id": [pdf["query_id"].to_numpy().astype("<i8").tobytes()], "q": [v.astype(kind).tobytes()], "floor": [pdf["floor"].to_numpy().astype("<i8").tobytes()]})

        def wanted(batches):
            """Annuli in the order of their bounds that any query of a block wants, and how many do."""
            for pdf in batches:
                for _, r in pdf.iterrows():
                    v = np.frombuffer(r["q"], kind).reshape(-1, dim).astype(np.float64) if dim else np.zeros((len(r["floor"]) // 8, 0))
                    want = (bounds(v, pivots, cat) >= np.frombuffer(r["floor"], "<i8")[:, None]).sum(0)
                    at = np.flatnonzero(want)
                    yield pd.DataFrame({"qb": np.full(len(at), r["qb"], np.int32), "pivot": pv[at], "annulus": an[at], "blocks": bl[at], "n_queries": want[at]})

        q = materialise(q.groupBy("qb").applyInPandas(packed_block, "qb int, query_id binary, q binary, floor binary"), "query-blocks")
        visits = q.mapInPandas(wanted, "qb int, pivot int, annulus int, blocks int, n_queries long")
        self.visits_at = scratch(self.spark, "visits")
        visits = materialise(visits.select("qb", "pivot", "annulus", "n_queries", block), "visits", self.visits_at)
        second = self._met(q, visits.select("qb", "pivot", "annulus", "block"), k)
        return self._top(second, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def compared(self, queries: int) -> float:
        """Share of all pairs of a query and a row that the last search scored in its second wave."""
        v = self.spark.read.parquet(self.visits_at).where("block = 0").select("pivot", "annulus", "n_queries").toPandas()  # query blocks times annuli
        pairs = v.merge(self.catalogue, on=["pivot", "annulus"])
        return float((pairs["n_queries"] * pairs["n"]).sum()) / max(1, queries * self.rows_n)


def top_k(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best other rows for each row whose id is divisible by ``every``.

    Components are floor(1024 x). Rows with a null id, a null or empty vector or
    null or non-finite components take no part; shorter vectors count as padded
    with zeros; ties go to the smaller id; a repeated id is answered once, and
    each of its rows can be an answer to others.
    """
    rows = materialise(table.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(vec_col).alias("v")), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"])
    return PivotIndex(rows).search(materialise(queries, "queries"), k)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in SQL for DuckDB.
OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INT) AS rank, vec_id, score FROM r WHERE rn <= 10
"""
