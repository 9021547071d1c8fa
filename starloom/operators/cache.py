"""The question cache: newest valid entry by hash or text, twins, poison, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.relational import first_by
from starloom.session import discard, written


def question_hash(x: Column | str) -> Column:
    return F.sha2(F.col(x) if isinstance(x, str) else x, 256)


def lookup(cache: DataFrame, asked: DataFrame, version: str, anonymised: int = 0) -> DataFrame:
    """The newest entry that isn't deleted for each asked (QUESTION_HASHED, UI_LANGUAGE)."""
    live = cache.where((F.coalesce("DELETED", F.lit(0)) == 0) & (F.col("API_VERSION") == version) & (F.coalesce("IS_ANONYMIZED", F.lit(0)) == anonymised))
    hit = live.join(asked.select("QUESTION_HASHED", "UI_LANGUAGE").distinct(), ["QUESTION_HASHED", "UI_LANGUAGE"], "left_semi")
    return first_by(hit, ["QUESTION_HASHED", "UI_LANGUAGE"], [-F.unix_micros(F.col("TIM_UPDATED").cast("timestamp")), -F.col("ID_ROW")])


def sql_limit(sql: Column | str) -> Column:
    """The number behind the last LIMIT, null if there is none."""
    c = F.col(sql) if isinstance(sql, str) else sql
    n = F.regexp_extract(c, r"(?i)\bLIMIT\s+(?:\d+\s*,\s*)?(\d+)(?:\s+OFFSET\s+\d+)?\s*;?\s*$", 1)
    return F.when(n != "", n.cast("long"))


def preferred_sql(raw: str, processed: str) -> Column:
    """The raw text if its limit is smaller than the processed one's."""
    a, b = sql_limit(raw), sql_limit(processed)
    return F.when(a.isNotNull() & (b.isNull() | (a < b)), F.col(raw)).otherwise(F.coalesce(processed, raw))


def twins(cache: DataFrame) -> DataFrame:
    """Pairs of a raw and an anonymised entry of one question, hash, version and language, and whether they agree."""
    on = ["QUESTION_HASHED", "API_VERSION", "UI_LANGUAGE", "QUESTION"]
    raw = cache.where("coalesce(IS_ANONYMIZED, 0) = 0").select(*on, F.col("ID_ROW").alias("raw_id"), F.col("SQL_QUERY").alias("raw_sql"))
    anon = cache.where("IS_ANONYMIZED = 1").select(*on, F.col("ID_ROW").alias("anon_id"), F.col("SQL_QUERY").alias("anon_sql"))
    return raw.join(anon, on).withColumn("same_sql", (F.col("raw_sql") == F.col("anon_sql")).cast("int"))


def twin_counts(cache: DataFrame) -> DataFrame:
    """(pairs, same_sql): numbers of all ``twins`` and of those that agree, from counts of each key and SQL text instead of pairs."""
    on = ["QUESTION_HASHED", "API_VERSION", "UI_LANGUAGE", "QUESTION"]
    anon = F.coalesce("IS_ANONYMIZED", F.lit(0))
    x = cache.dropna(subset=on).groupBy(*on, "SQL_QUERY").agg(F.count_if(anon == 0).alias("r"), F.count_if(anon == 1).alias("a"))
    same = F.when(F.col("SQL_QUERY").isNotNull(), F.col("r") * F.col("a")).otherwise(0)
    x = x.groupBy(*on).agg((F.sum("r") * F.sum("a")).alias("pairs"), F.sum(same).alias("same_sql"))
    return x.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "same_sql")])


def poisoned(cache: DataFrame, pattern: str) -> DataFrame:
    """Anonymised entries whose SQL holds a literal name instead of a placeholder."""
    return cache.where((F.col("IS_ANONYMIZED") == 1) & F.col("SQL_QUERY").rlike(pattern))


def semantic_hits(near: DataFrame, asked_names: str, cached_names: str, most: float = 0.15) -> DataFrame:
    """Nearest questions below a distance that hold all placeholder names of the asked one."""
    return near.where((F.col("distance") < most) & (F.size(F.array_except(asked_names, cached_names)) == 0))


def pruned_tree(categories: DataFrame, leaves: DataFrame, id_col: str = "id", parent: str = "id_parent") -> DataFrame:
    """Categories that hold a leaf somewhere below, and can be reached from one without parent: (id, depth).

    ``up`` holds each category with what stands 2^n steps above it. A round adds
    to the used categories what stands so far above them, to the depths those of
    categories so far below, and doubles the steps: as many rounds as a depth
    has binary digits, at any number of rows. A category below several parents
    has every depth at which it is reached; a cycle below a root ends with an
    error, as its depths have no end.
    """
    spark = categories.sparkSession
    rows = categories.select(F.col(id_col).alias("id"), F.col(parent).alias("above"))
    count = rows.count()
    kept: dict[str, tuple[DataFrame, str]] = {}

    def keep(name: str, df: DataFrame) -> int:
        old = kept.get(name)
        kept[name] = written(df, name)
        if old:
            discard(spark, old[1])
        return kept[name][0].count()

    ids = rows.select("id").distinct()
    keep("up", rows.join(ids.withColumnRenamed("id", "above"), "above", "left_semi").distinct())
    used = keep("used", leaves.select(F.col(leaves.columns[0]).alias("id")).distinct().join(ids, "id", "left_semi"))
    reached = keep("depths", rows.where("above IS NULL").select("id", F.lit(0).alias("depth")).distinct())
    steps = 1
    while True:
        up, marks, depths = (kept[n][0] for n in ("up", "used", "depths"))
        above = up.join(marks, "id").select(F.col("above").alias("id"))
        below = up.join(depths.withColumnRenamed("id", "above"), "above").select("id", (F.col("depth") + steps).alias("depth"))
        more_used, more_reached = keep("used", marks.unionByName(above).distinct()), keep("depths", depths.unionByName(below).distinct())
        if (more_used, more_reached) == (used, reached):
            break
        used, reached, steps = more_used, more_reached, steps * 2
        if steps > 2 * count:
            raise ValueError("a category stands above itself and below a root, so its depths have no end")
        keep("up", up.join(up.select(F.col("id").alias("above"), F.col("above").alias("higher")), "above").select("id", F.col("higher").alias("above")).distinct())
    discard(spark, kept["up"][1])
    return kept["depths"][0].join(kept["used"][0], "id")


def same_side(cache: DataFrame) -> Column:
    """Whether a row is an anonymised twin that can be reached by its raw question only: both texts are the same."""
    return (F.coalesce("IS_ANONYMIZED", F.lit(0)) == 1) & (F.col("QUESTION_ANONYMIZED") == F.col("QUESTION"))


def append(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries behind it.

    An entry has (QUESTION, QUESTION_ANONYMIZED, ...); each gives a raw row and,
    unless both texts are equal, an anonymised one under the raw question's hash.
    """
    h = question_hash("QUESTION")
    raw = entries.withColumn("QUESTION_HASHED", h).withColumn("IS_ANONYMIZED", F.lit(0))
    anon = entries.where(F.coalesce(F.col("QUESTION_ANONYMIZED") != F.col("QUESTION"), F.lit(False))).withColumn("QUESTION_HASHED", h).withColumn("QUESTION", F.col("QUESTION_ANONYMIZED")).withColumn("IS_ANONYMIZED", F.lit(1))
    return cache.unionByName(raw.unionByName(anon).drop("QUESTION_ANONYMIZED"), allowMissingColumns=True)


def retired(cache: DataFrame, pattern: str) -> DataFrame:
    """Both sides of a twin whose raw SQL holds a literal name are marked deleted; of other twins with equal texts only the anonymised one."""
    on = ["QUESTION_HASHED", "API_VERSION", "UI_LANGUAGE", "QUESTION"]
    side, live = F.coalesce("IS_ANONYMIZED", F.lit(0)), F.coalesce("DELETED", F.lit(0)) == 0
    text = F.coalesce("SQL_QUERY", F.lit(""))
    per = cache.where(live).groupBy(*on).agg(F.max(F.when(side == 0, F.coalesce(F.col("SQL_QUERY").rlike(pattern), F.lit(False)))).alias("_poison"), F.count_if(side == 1).alias("_anon"))
    raws = cache.where(live & (side == 0)).select(*on, text.alias("_text")).distinct().withColumn("_raw", F.lit(True))
    x = cache.join(per, on, "left").withColumn("_text", text).join(raws, [*on, "_text"], "left")
    poisoned_pair = (F.col("_anon") > 0) & F.col("_poison") & ((side == 1) | F.col("SQL_QUERY").rlike(pattern))
    gone = live & (poisoned_pair | ((side == 1) & F.col("_raw")))
    return x.select(*[F.when(F.coalesce(gone, F.lit(False)), 1).otherwise(F.col(c)).alias(c) if c == "DELETED" else c for c in cache.columns])
