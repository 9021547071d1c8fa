"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    n = partitions or (cores if isinstance(cores, int) else 8)
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cores}]").appName("starloom").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of one folder, read when first asked for: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self._spark, self._dir, name)

    def register(self, *names: str) -> None:
        for n in names or TABLES:
            getattr(self, n).createOrReplaceTempView(n)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(``df`` written as Parquet below ``spark.checkpoint.dir`` and read again, its path): for what is read several times.

    The files outlive lost executors. Where the setting is unset a local session
    gets a temporary folder; a cluster fails.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="starloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
