"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned to their principal axes, fitted on a bounded sample
(a rotation, so it changes no cosine). Two vectors with a cosine of at least c
are at most sqrt(2 - 2c) apart, in every axis too: a label's vectors are laid on
a grid of that width over the leading axis, or up to three where labels are
large, and a cell of over ``TILE`` vectors is cut again along the next axis, up
to ``AXES`` of them. Cells and their
tiles of at most ``TILE`` vectors are paired only if they are neighbours on the
grid and the boxes around their vectors, over all these axes, are near enough;
that is decided before any vector is copied. In a pair of tiles products are
summed over leading dimensions first; what remains is bounded by the product of
the suffix norms, and a pair stops when it can't reach c.

Equal vectors of a label are one class with a multiplicity. A pair of tiles gives
back numbers of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import components, hot_counted, materialise, salted_join, ship
from starloom.llm.pivot_index import usable

TILE = 1024
#: Rows that the axes are fitted on.
SAMPLE = 4096
#: Ends of the groups of dimensions that are summed in turn.
STEPS = (16, 32)
#: Axes that cells may be cut along and boxes are held over, and the most of the grid that every cell is on.
AXES, GRID = 8, 3


def _keyed(batches):
    for b in batches:
        packed = [np.asarray(v, np.float64).tobytes() for v in b.column("embedding").to_pylist()]
        keys = [np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64) for x in packed]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([int(k[0]) for k in keys], pa.int64()), pa.array([int(k[1]) for k in keys], pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "label", "k1", "k2", "v"])


def _unit(packed, dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim))
    for i, x in enumerate(packed):
        v = np.frombuffer(x, np.float64)
        out[i, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)  # keeps squares of huge and tiny vectors finite
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> np.ndarray:
    """Matrix of pairs with a cosine of at least ``least``; rows are unit vectors."""
    ra, rb = a @ axes, b @ axes
    d = ra.shape[1]
    slack = least - 1e-9
    stops = [s for s in STEPS if s < d]
    if not stops:
        out = ra @ rb.T >= slack
    else:
        s = stops[0]
        part = ra[:, :s] @ rb[:, :s].T
        tail = lambda m, s: np.sqrt((m[:, s:] ** 2).sum(1))
        i, j = np.nonzero(part + np.outer(tail(ra, s), tail(rb, s)) >= slack)
        part = part[i, j]
        for s, e in zip(stops, [*stops[1:], d], strict=True):
            if len(i) * 4 > part.size and len(i) > 0.2 * len(a) * len(b):  # most pairs are alive: sum them all at once
                whole = ra[:, s:e] @ rb[:, s:e].T
                part = part + whole[i, j]
            else:
                part = part + np.concatenate([np.einsum("ij,ij->i", ra[i[k : k + 65536], s:e], rb[j[k : k + 65536], s:e]) for k in range(0, len(i), 65536)] or [np.array([])])
            ok = part + (tail(ra, e)[i] * tail(rb, e)[j] if e < d else 0) >= slack
            i, j, part = i[ok], j[ok], part[ok]
        out = np.zeros((len(a), len(b)), bool)
        out[i, j] = True
    i, j = np.nonzero(out)
    for k in range(0, len(i), 65536):  # the final word, in the given coordinates
        x, y = i[k : k + 65536], j[k : k + 65536]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= least
    return out


def _forest(m: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component, of the bipartite graph m."""
    nodes, roots = [], []
    todo = m.any(1)
    while todo.any():
        rows = np.zeros(len(m), bool)
        rows[int(todo.argmax())] = True
        while True:
            cols = m[rows].any(0)
            more = m[:, cols].any(1)
            if (more == rows).all():
                break
            rows = more
        ids = np.concatenate([left[rows], right[cols]])
        nodes.append(ids)
        roots.append(np.full(len(ids), ids.min()))
        todo &= ~rows
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (np.array([], np.int64), np.array([], np.int64))


def near_vectors(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors with a null label, null or zero vectors and those with null or
    non-finite components link with nothing; a null id gives a null component.
    Vectors of different lengths count as padded with zeros. Rows with a
    repeated id count as several vectors of one node.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")).where(F.exists("embedding", lambda x: x != 0))
    label = rows.schema["label"].dataType.simpleString()
    keyed = materialise(good.mapInArrow(_keyed, f"vec_id long, label {label}, k1 long, k2 long, v binary"), "keyed")
    classes = materialise(keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v")), "classes")
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()]  # a fixed number of rows
    dim = (classes.agg(F.max(F.length("v"))).first()[0] or 8) // 8
    axes = np.eye(dim)
    if sample:
        s = _unit(sample, dim)
        axes = np.linalg.eigh(s.T @ s)[1][:, ::-1].copy()
    width = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6)

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                y = _unit(pdf["v"].tolist(), dim) @ axes[:, :AXES]
                y = np.pad(y, ((0, 0), (0, AXES - y.shape[1])))
                yield pdf.assign(y=list(y), g=list(np.floor(y / width).astype(np.int64)))

    placed = materialise(classes.select("label", "rep", "mult", "v").mapInPandas(cells, f"label {label}, rep long, mult long, v binary, y array<double>, g array<long>"), "cells")
    # a larger label has more cells, which find their neighbours on a grid of more axes
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = next((n for n in range(1, GRID) if largest <= TILE * 8 ** (n + 1)), GRID)
    # the shortest beginning of a grid place that holds few enough vectors is its cell
    cell = lambda n: F.array_join(F.slice("g", 1, n), ",")
    places = materialise(placed.groupBy("label", "g").agg(F.count("*").alias("n")), "places")
    every = places.withColumn("depth", F.explode(F.sequence(F.lit(grid), F.lit(AXES)))).withColumn("c", cell(F.col("depth")))
    few = every.groupBy("label", "depth", "c").agg(F.sum("n").alias("total"))
    fits = every.join(few, ["label", "depth", "c"]).groupBy("label", "g").agg(F.min(F.when(F.col("total") <= TILE, F.col("depth"))).alias("depth"))
    places = places.join(fits, ["label", "g"]).select("label", "g", "n", cell(F.coalesce("depth", F.lit(AXES))).alias("c"))
    places = materialise(places, "place-cells")
    tiles = places.groupBy("label", "c").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(places.select("label", "g", "c"), ["label", "g"]).join(tiles, ["label", "c"])
    tiled = materialise(tiled.withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).drop("tiles"), "tiles")
    box = lambda f: F.array(*[f(F.col("y")[k]) for k in range(AXES)])
    boxes = tiled.groupBy("label", "c", "t").agg(box(F.min).alias("lo"), box(F.max).alias("hi"), F.slice(F.first("g"), 1, grid).alias("g"))
    boxes = materialise(boxes, "boxes")
    # pairs of tiles in neighbouring grid places, each once
    half = [d for d in itertools.product((-1, 0, 1), repeat=grid) if d >= (0,) * grid]
    steps = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in d]) for d in half]))
    one = boxes.withColumn("st", steps).withColumn("g2", F.zip_with("g", "st", lambda x, y: x + y))
    two = boxes.select("label", F.col("c").alias("c2"), F.col("t").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("g").alias("g2"))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(AXES - 1)), F.lit(0.0), lambda s, k: s + F.pow(F.greatest(F.lit(0.0), F.get("lo2", k) - F.get("hi", k), F.get("lo", k) - F.get("hi2", k)), F.lit(2.0)))
    tasks = one.join(two, ["label", "g2"]).where(gap <= width * width)
    once = (F.col("c") < F.col("c2")) | ((F.col("c") == F.col("c2")) & (F.col("t") <= F.col("j")))
    tasks = tasks.where(once | F.exists("st", lambda x: x != 0)).select("label", "c", F.col("t").alias("i"), "c2", "j")
    tasks = materialise(tasks, "tile-pairs")
    own = (F.col("c") == F.col("c2")) & (F.col("i") == F.col("j"))
    left = tasks.join(tiled.withColumnRenamed("t", "i"), ["label", "c", "i"]).select("label", "c", "i", "c2", "j", "rep", "mult", "v", F.lit(0).alias("side"))
    right = tasks.where(~own).join(tiled.select("label", F.col("c").alias("c2"), F.col("t").alias("j"), "rep", "mult", "v"), ["label", "c2", "j"]).select("label", "c", "i", "c2", "j", "rep", "mult", "v", F.lit(1).alias("side"))

    def compare(pdf):
        l, r = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = not len(r) and (pdf.c.iloc[0], pdf.i.iloc[0]) == (pdf.c2.iloc[0], pdf.j.iloc[0])
        r = l if same else r
        out = {"node": np.array([], np.int64), "links": np.array([], np.int64), "root": np.array([], np.int64)}
        if len(l) and len(r):
            a = _unit(l.v.tolist(), dim)
            m = linked(a, a if same else _unit(r.v.tolist(), dim), axes, least)
            if same:
                np.fill_diagonal(m, False)
            la, lb = l.rep.to_numpy(), r.rep.to_numpy()
            node, root = _forest(m, la, lb)
            if same:
                node, at = np.unique(node, return_index=True)
                root = root[at]
            links = dict(zip(la.tolist(), (m @ r.mult.to_numpy()).tolist(), strict=True))
            if not same:
                links |= dict(zip(lb.tolist(), (m.T @ l.mult.to_numpy()).tolist(), strict=True))
            out = {"node": node, "links": np.array([links[x] for x in node.tolist()], np.int64), "root": root}
        return pd.DataFrame(out)

    keys = ["label", "c", "i", "c2", "j"]
    found = materialise(left.unionByName(right).groupBy(*keys).applyInPandas(compare, "node long, links long, root long"), "links")
    comp = components(found.where("node <> root"), "node", "root").select(F.col("node").alias("rep"), F.col("component").alias("c"))
    sums = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("l"))
    per = classes.select("label", "k1", "k2", "rep", "mult").join(sums, "rep", "left").join(comp, "rep", "left")
    per = per.select("label", "k1", "k2", (F.coalesce("l", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c"))
    mine = salted_join(keyed.drop("v"), per, ["label", "k1", "k2"], columns=["vec_id"], hot=hot_counted(classes, ["label", "k1", "k2"], "mult")).select("vec_id", "n_links", "c")
    alone = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("c"))
    return mine.unionByName(alone).select("vec_id", "n_links", F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same in SQL for DuckDB.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT CAST(count(*) AS BIGINT) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id
"""
