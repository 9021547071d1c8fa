"""What several corpus operators need: the shared folder, materialised tables and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary one (tests); a cluster fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="starloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor costs only a re-read. Unlike a local checkpoint the files
    outlive every executor.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", codec).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_starloom_shipped", False):
        return
    to = os.path.join(tempfile.mkdtemp(prefix="starloom-zip-"), "starloom.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in (root / "starloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(to)
    spark.sparkContext._starloom_shipped = True


#: Keys with more than one row in so many are salted, so there are fewer of them than that; and over how many salts.
HOT, SALTS = 1024, 32
#: Nodes of a graph from which its hubs are looked for and salted.
HUBS = 1_000_000


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys that over one in ``HOT`` rows hold: fewer than ``HOT`` rows, None if there are none. Null keys aren't among them."""
    total, bucket = rows.count(), F.pmod(F.xxhash64(*keys), F.lit(4 * HOT))
    most = max(1, total // HOT)
    mine = rows.select(*keys).dropna()
    # a hot key fills its bucket, and few buckets are that full without one
    full = [r[0] for r in mine.groupBy(bucket.alias("b")).count().where(F.col("count") > most).select("b").collect()]
    return written(mine.where(bucket.isin(full)).groupBy(*keys).count().where(F.col("count") > most).select(*keys)) if full else None


def hot_counted(counts: DataFrame, keys: list[str], n: str) -> DataFrame | None:
    """The same from a table that holds each key once, with its number of rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return written(counts.where(F.col(n) > max(1, total // HOT)).select(*keys).dropna())


def written(few: DataFrame) -> DataFrame | None:
    """A small table written and read again; None if it is empty."""
    few = materialise(few, "hot-keys")
    return None if few.isEmpty() else few


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", columns: list | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to a side with few rows a key; rows of ``hot`` keys are dealt over ``SALTS`` copies of the other side's.

    ``hot`` holds fewer than ``HOT`` rows and is sent to every task. ``how`` is
    inner, left, left_semi or left_anti; null keys match nothing. ``columns``
    tell the rows of a key apart, by default all of ``left``'s but the keys.
    """
    if hot is None:
        return left.join(right, keys, how)
    held = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    by = columns or [c for c in left.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    x = left.join(held, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    y = right.join(held, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return x.join(y, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node reachable.

    Contraction: every node moves to the smallest neighbour, pointers are
    followed twice, edges are renamed and their duplicates and loops dropped;
    the remaining graph shrinks by a constant factor each round, so rounds grow
    with the logarithm of the longest path. Degrees are reduced map-side
    (``min``), so a hub costs no large group. Null ends are ignored; loops name
    their node as a component of its own. Every round is written to the shared
    folder, the driver only sees two counters.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        return materialise(df, name, path), path

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e, at = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total: DataFrame | None = None
    total_at = ""
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        near, near_at = kept(near, "near")
        hop = near.select(F.col("u").alias("m"), F.col("m").alias("m2"))
        many = near.count() > HUBS  # below, a hub's rows are few
        step = salted_join(near, hop, ["m"], hot=hot_keys(near, ["m"]) if many else None).select("u", F.col("m2").alias("p"))
        step, step_at = kept(step, "step")
        pu = step.select("u", F.col("p").alias("pu"))
        pv = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        # u is the greater end: the hub of a star is on the other side
        moved = e.join(pu, "u")
        moved = salted_join(moved, pv, ["v"], hot=hot_keys(e, ["v"]) if many else None, columns=["u"]).where("pu <> pv")
        e, new_at = kept(moved.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        for old in (at, near_at):
            discard(spark, old)
        at = new_at
        if total is None:
            total, total_at = step, step_at
        else:
            jump = step.select(F.col("u").alias("p"), F.col("p").alias("p2"))
            out = salted_join(total, jump, ["p"], "left", hot=hot_keys(total, ["p"]) if many else None).select("u", F.coalesce("p2", "p").alias("p"))
            out, out_at = kept(out, "total")
            discard(spark, total_at)
            discard(spark, step_at)
            total, total_at = out, out_at
    else:
        raise RuntimeError("components: not converged")
    if total is None:
        kind = edges.schema[a].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return total.select(F.col("u").alias("node"), F.col("p").alias("component"))


def slices(batch, size: int = 4_000_000):
    """Parts of an Arrow batch of (id, text) whose texts hold about ``size`` bytes; a longer text is a part of its own."""
    import pyarrow.compute as pc

    lengths, at, held = pc.binary_length(batch.column(1)).to_pylist(), 0, 0
    for i, n in enumerate(lengths):
        if held and held + (n or 0) > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += (n or 0) + 1
    if at < batch.num_rows:
        yield batch.slice(at)
