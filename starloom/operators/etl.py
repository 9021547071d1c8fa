"""Read-model ETL: upserts, deletes, flags to rows, normalisation with rejects, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.text import version_key


def upsert(target: DataFrame, changes: DataFrame, key: Sequence[str], insert_only: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """``target`` with ``changes``: the last change of a key by ``order`` wins, columns it lacks stay, insert-only columns keep their first value.

    Without an order a key that is changed twice fails the query.
    """
    if not order:
        one = changes.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*changes.columns)).alias("_r"))
        changes = one.select(F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("a key is changed twice, and no order says which change is last"))).alias("_r")).select("_r.*")
    else:
        changes = changes.groupBy(*key).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("_r")).select("_r.*")
    cols = [*target.columns, *[c for c in changes.columns if c not in target.columns]]
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(1).alias("_old"))
    c = changes.select(*[F.col(x).alias(f"c_{x}") for x in changes.columns], F.lit(1).alias("_new"))
    on = [F.col(f"t_{k}").eqNullSafe(F.col(f"c_{k}")) for k in key]
    j = t.join(c, on, "full_outer")

    def pick(n: str) -> Column:
        old = F.col(f"t_{n}") if n in target.columns else F.lit(None)
        if n not in changes.columns:
            return old.alias(n)
        new = F.col(f"c_{n}")
        if n in insert_only:
            return F.when(F.col("_old").isNotNull(), old).otherwise(new).alias(n)
        return F.when(F.col("_new").isNotNull(), new).otherwise(old).alias(n)

    return j.select(*[pick(n) for n in cols])


def soft_delete(df: DataFrame, gone: Column) -> DataFrame:
    return df.withColumn("DELETED", F.when(gone, 1).otherwise(F.col("DELETED")))


def hard_delete(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("DELETED"), F.lit(0)) != 1)


def flags_to_rows(df: DataFrame, id_col: str, flags: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each flag that is set, in the given order; null counts as 0."""
    items = F.array(*[F.struct(F.lit(i).alias("DISPLAY_ORDER"), F.lit(v).alias("VALUE"), (F.coalesce(F.col(f), F.lit(0)) == 1).alias("on")) for i, (f, v) in enumerate(flags, 1)])
    return df.select(id_col, F.explode(F.filter(items, lambda x: x["on"])).alias("x")).select(id_col, "x.VALUE", "x.DISPLAY_ORDER")


#: Canonical aspect ratios and other spellings than ``x,yz``, ``x.yz``, ``x:yz``, ``x.yz:1`` (fixed values).
ASPECT_RATIOS = {
    "1.33": ("4:3", "4/3", "4x3", "133:100", "fullscreen", "full screen"),
    "1.37": ("137:100", "academy", "academy ratio", "academy aperture"),
    "1.43": ("imax", "imax 70mm", "imax 1.43"),
    "1.66": ("5:3", "15:9", "166:100", "european widescreen"),
    "1.78": ("16:9", "16/9", "16x9", "178:100", "hdtv"),
    "1.85": ("widescreen", "flat", "us widescreen", "185:100"),
    "2.00": ("2:1", "univisium"),
    "2.20": ("70mm widescreen",),
    "2.35": ("235:1",),
    "2.39": ("239:1", "21:9", "modern anamorphic"),
    "2.40": ("240:1",),
    "2.55": ("255:1", "cinemascope 55"),
    "2.76": ("ultra panavision", "mgm camera 65"),
}


def aspect_ratio(x: Column | str) -> Column:
    """The canonical ratio of a raw entry; null for what has none (1.77, 1.89 and 1.90 among them)."""
    c = F.regexp_replace(F.lower(F.trim(F.col(x) if isinstance(x, str) else x)), r"""^["']+|["']+$""", "")
    plain = F.regexp_replace(F.regexp_replace(c, r"^(\d)[,:](\d\d)(:1)?$", "$1.$2"), r"^(\d\.\d\d):1$", "$1")
    out = F.when(plain.isin(*ASPECT_RATIOS), plain)
    for name, spelled in ASPECT_RATIOS.items():
        out = out.when(c.isin(*spelled), name)
    return out


def normalise_or_reject(df: DataFrame, value: str, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted with ``CANONICAL``, rejected values with their counts)."""
    x = df.withColumn("CANONICAL", canonical)
    return x.where("CANONICAL IS NOT NULL"), x.where(f"CANONICAL IS NULL AND `{value}` IS NOT NULL").groupBy(value).agg(F.count("*").alias("n"))


def ordinals(df: DataFrame, id_col: str, primary: str, others: str) -> DataFrame:
    """Primary value first, then the list's other values once each, numbered from 1."""
    all_ = F.array_distinct(F.filter(F.concat(F.array(primary), F.coalesce(F.col(others), F.array().cast("array<string>"))), lambda v: v.isNotNull() & (F.trim(v) != "")))
    return df.select(id_col, F.posexplode(all_).alias("i", "VALUE")).select(id_col, "VALUE", (F.col("i") + 1).alias("DISPLAY_ORDER"))


def resync(target: DataFrame, scope: Column, fresh: DataFrame) -> DataFrame:
    """Rows of the scope are replaced, all others stay; running it twice changes nothing."""
    return target.where(~F.coalesce(scope, F.lit(False))).unionByName(fresh)


def require_lookup(facts: DataFrame, key: str, lookup: DataFrame, lookup_key: str) -> None:
    """Fail with some missing keys if a fact has no lookup row."""
    lost = facts.where(F.col(key).isNotNull()).join(lookup.select(F.col(lookup_key).alias(key)), key, "left_anti").select(key).distinct().limit(10).collect()
    if lost:
        raise ValueError(f"no lookup row for {key}: {[r[0] for r in lost]}")


def refresh_counters(dim: DataFrame, id_col: str, edges: DataFrame, edge_key: str, counted: str, name: str) -> DataFrame:
    n = edges.groupBy(F.col(edge_key).alias(id_col)).agg(F.countDistinct(counted).alias(name))
    return dim.drop(name).join(n, id_col, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def compacted(logs: DataFrame, stamp: str) -> DataFrame:
    """Rows with their month, clustered by month and day, for a partitioned rewrite: no task holds a whole month."""
    return logs.withColumn("yyyymm", F.date_format(stamp, "yyyyMM")).repartition(F.col("yyyymm"), F.to_date(stamp))


def changed_only(new: DataFrame, old: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose content hash isn't there yet."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256).alias("_hash")
    return new.select("*", h).join(old.select(key, h), [key, "_hash"], "left_anti").drop("_hash")


def backup(df: DataFrame, key: str, involved: DataFrame, path: str) -> DataFrame:
    """Write the rows of the involved ids aside, before they are changed; the rows as read back."""
    df.join(involved.select(F.col(involved.columns[0]).alias(key)).distinct(), key, "left_semi").write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_variable(variables: DataFrame, name: str, value, lang: str = "") -> DataFrame:
    """(VAR_NAME, LANG, VAR_VALUE) with one value set; a blank language is the general one."""
    new = variables.sparkSession.createDataFrame([(name, lang, None if value is None else str(value))], "VAR_NAME string, LANG string, VAR_VALUE string")
    return upsert(variables, new, ["VAR_NAME", "LANG"])


def get_variable(variables: DataFrame, name: str, lang: str = "") -> DataFrame:
    return variables.where((F.col("VAR_NAME") == name) & (F.coalesce("LANG", F.lit("")) == lang)).select("VAR_VALUE")


def without_vectors(vectors: DataFrame, prefix: str | None = None, version: str | None = None) -> DataFrame:
    """Vectors that stay when those of an id prefix, of older versions, or (with neither) all go."""
    gone = F.lit(True)
    if prefix is not None:
        gone = gone & F.startswith(F.col("id"), F.lit(prefix))
    if version is not None:
        gone = gone & (version_key("version") < version_key(F.lit(version)))
    return vectors.where(~F.coalesce(gone, F.lit(False)))


def update_join(target: DataFrame, source: DataFrame, key: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``target`` with columns set where ``source`` has a row of its key; a key's other rows don't fan out."""
    hit = source.select(*key).distinct().withColumn("_hit", F.lit(True))
    j = target.join(hit, list(key), "left")
    return j.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in target.columns])
