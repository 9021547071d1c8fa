"""Sources and sinks: question banks, logs, exports, settings."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.text import slug
from starloom.operators.etl import changed_only, compacted

BANK_SCHEMA = "evaluation_id int, evaluation_category_id int, question_en string, question_fr string, assertions struct<entity_extraction:string, sql_query:string, query_result:string>, is_eval int, is_sample int, display_order int, deleted int"


def read_bank(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Evaluation questions (one JSON object a file, or a line) that are active and assert something."""
    bank = spark.read.schema(BANK_SCHEMA).json(path, multiLine=not lines)
    said = F.col("assertions.query_result")
    return bank.where((F.col("is_eval") == 1) & (F.coalesce(F.col("deleted"), F.lit(0)) == 0) & (F.trim(said) != ""))


def read_bank_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Evaluation questions of a database table that are active and assert something; the predicate runs in the database."""
    t = read_jdbc(spark, url, table, **options)
    return t.where((F.col("IS_EVAL") == 1) & ((F.col("DELETED") == 0) | F.col("DELETED").isNull()) & (F.trim(F.col("ASSERTIONS")) != ""))


def export_changed(df: DataFrame, old: DataFrame, key: str, title: str, path: str) -> DataFrame:
    """Write rows whose content changed as JSON, with the file name each would have, into a folder of their own below ``path``; the rows as read back."""
    new = changed_only(df, old, key, [c for c in df.columns if c != key])
    out = new.withColumn("file", F.concat(F.col(key).cast("string"), F.lit("_"), slug(title), F.lit(".json")))
    at = f"{path}/batch-{uuid.uuid4().hex}"
    out.write.json(at)
    return df.sparkSession.read.schema(out.schema).json(at)


def append_log(df: DataFrame, stamp: str, path: str) -> None:
    df.withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").json(path)


def compact_logs(df: DataFrame, stamp: str, path: str) -> dict[str, int]:
    """Rewrite loose log rows as one folder a month, read it back and compare the counts; rows by month.

    Months that stay where they are aren't touched, so stragglers of a month must
    come with its other rows. The caller deletes the loose files afterwards.
    """
    want = {r[0]: r[1] for r in df.groupBy(F.date_format(stamp, "yyyyMM")).count().collect()}  # a row a month
    x = compacted(df, stamp)
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm").parquet(path)
    got = {str(r[0]): r[1] for r in df.sparkSession.read.parquet(path).groupBy("yyyymm").count().collect()}
    lost = {m: n for m, n in want.items() if got.get(str(m)) != n and m is not None}
    if lost:
        raise OSError(f"compaction lost rows of {sorted(lost)}")
    return {m: n for m, n in want.items() if m is not None}


def write_stragglers(loose: DataFrame, old: DataFrame, stamp: str, path: str) -> dict[str, int]:
    """Compact loose rows together with the months that they belong to."""
    months = loose.select(F.date_format(stamp, "yyyyMM").alias("m")).distinct()
    same = old.where(F.col(stamp).isNotNull()).join(months, F.date_format(stamp, "yyyyMM") == F.col("m"), "left_semi").select(*loose.columns)
    return compact_logs(loose.unionByName(same), stamp, path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, low: int = 0, high: int = 0) -> DataFrame:
    """A database table, read in parallel ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def has_columns(df: DataFrame, *names: str) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [n for n in names if n.lower() not in have]


class Settings:
    """Driver-side JSON files that are read again when they change."""

    def __init__(self):
        self._files: dict[str, tuple[float, object, Callable | None]] = {}

    def register(self, path: str, changed: Callable | None = None) -> object:
        self._files[path] = (-1.0, None, changed)
        return self.get(path)

    def get(self, path: str) -> object:
        stamp, value, changed = self._files[path]
        now = os.stat(path).st_mtime
        if now != stamp:
            with open(path, encoding="utf-8") as f:
                value = json.load(f)
            self._files[path] = (now, value, changed)
            if changed is not None:
                changed(value)
        return value
