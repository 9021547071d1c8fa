"""Relational operators that Spark has no single call for, composed from DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE, MOST = 50, 200


def distinct_sorted(df: DataFrame, columns: Sequence[str], sort: Sequence[tuple[str, bool]]) -> DataFrame:
    """SELECT DISTINCT columns ... ORDER BY columns that aren't selected: the least (greatest) hidden value of each row sorts it."""
    hidden = [(c, d) for c, d in sort if c not in columns]
    if hidden:
        out = df.groupBy(*columns).agg(*[(F.max(c) if d else F.min(c)).alias(f"_sort_{c}") for c, d in hidden])
    else:
        out = df.select(*columns).distinct()
    order = [(F.col(c if c in columns else f"_sort_{c}").desc() if d else F.col(c if c in columns else f"_sort_{c}").asc()) for c, d in sort]
    return out.orderBy(*order, *[c for c in columns if c not in {s for s, _ in sort}]).select(*columns)


def related(left: DataFrame, left_id: str, edges: DataFrame, left_key: str, right_key: str, right_ids: DataFrame, right_id: str) -> DataFrame:
    """Distinct rows of ``left`` with an edge to any of ``right_ids``: two semi joins, so nothing fans out."""
    wanted = edges.join(right_ids.select(F.col(right_id).alias(right_key)), right_key, "left_semi").select(F.col(left_key).alias(left_id))
    return left.join(wanted, left_id, "left_semi")


def all_of(edges: DataFrame, key: str, member: str, members: DataFrame) -> DataFrame:
    """Keys that have an edge to every row of ``members`` (relational division); none if ``members`` is empty.

    Only edges to members are counted, map-side first, so a hot key costs one row a task.
    """
    m = members.select(F.col(members.columns[0]).alias(member)).distinct()
    n = m.agg(F.count("*").alias("_need"))
    have = edges.join(m, member, "left_semi").groupBy(key).agg(F.countDistinct(member).alias("_have"))
    return have.crossJoin(F.broadcast(n)).where("_have = _need").select(key)  # one row


def top_n(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= n)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: a partial aggregation of the least sort key, no sort of whole groups."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("_row")).select("_row.*")


def first_wins(df: DataFrame, external: str, order: Sequence[Column]) -> DataFrame:
    """One row for each external id, blanks never collapse."""
    blank = F.coalesce(F.trim(F.col(external)), F.lit("")) == ""
    rest = first_by(df.where(~blank), [external], order)
    return df.where(blank).unionByName(rest)


def rank_entities(df: DataFrame, columns: Sequence[str], counted: str, name: str) -> DataFrame:
    """All entity columns with the number of distinct related ids."""
    return df.groupBy(*columns).agg(F.countDistinct(counted).alias(name))


def pivot_max(df: DataFrame, key: Sequence[str], kind: str, value: str, kinds: dict[str, str], preferred: Column | None = None) -> DataFrame:
    """One column for each kind with its greatest value, or with its preferred-first value if ``preferred`` sorts rows."""
    pick = (lambda k: F.max(F.when(F.col(kind) == k, F.col(value)))) if preferred is None else (lambda k: F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.struct(preferred.alias("p"), F.col(value).alias("v")))))
    return df.groupBy(*key).agg(*[pick(k).alias(name) for k, name in kinds.items()])


def flags_summed(df: DataFrame, flags: dict[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Numbers of rows for which each condition holds; null counts as no."""
    return df.groupBy(*key).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def share_of_total(df: DataFrame, key: Sequence[str], value: Column, digits: int = 4) -> DataFrame:
    """Sum for each key and its share of all; the window runs over one row a key."""
    g = df.groupBy(*key).agg(F.sum(value).alias("total"))
    return g.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), digits))


def nearest_rank(df: DataFrame, value: str, p: float, key: Sequence[str] = (), bins: int = 4096) -> DataFrame:
    """The element at position min(n - 1, round-half-even(p (n - 1))) of the sorted non-null values.

    Equal bins between a key's least and greatest value are counted map-side; one
    bin holds the position, and only its distinct values are sorted. So no task
    sorts a key's rows.
    """
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*key, F.col(value).alias("value"))
    x = x.withColumn("_all", F.lit(1))
    on = [*key, "_all"]
    ends = x.groupBy(*on).agg(F.count("*").alias("_n"), F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"))
    ends = ends.withColumn("_at", F.least(F.col("_n") - 1, F.bround(F.lit(p) * (F.col("_n") - 1), 0).cast("long")))
    width = F.col("_hi") / bins - F.col("_lo") / bins  # no overflow between opposite ends
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value").cast("double") - F.col("_lo")) / width))).otherwise(F.lit(0))
    placed = x.join(ends, on).withColumn("_bin", bin_.cast("int"))
    counts = placed.groupBy(*on, "_bin").agg(F.count("*").alias("_c"), F.first("_at").alias("_at"))
    w = Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hit = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
    inside = placed.join(hit.select(*on, "_bin", "_before"), [*on, "_bin"]).groupBy(*on, "value").agg(F.count("*").alias("_c"), F.first("_at").alias("_at"), F.first("_before").alias("_before"))
    w = Window.partitionBy(*on).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_i", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    return inside.where((F.col("_i") <= F.col("_at")) & (F.col("_at") < F.col("_i") + F.col("_c"))).select(*key, "value")


def neighbours(df: DataFrame, order: Sequence[Column], id_col: str, partition: Sequence[str] = ()) -> DataFrame:
    """Ids of the previous and next row in an order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("previous_id", F.lag(id_col).over(w)).withColumn("next_id", F.lead(id_col).over(w))


def aligned_union(*frames: tuple[str, DataFrame, dict[str, str]], kind: str = "CONTENT_TYPE") -> DataFrame:
    """Rows of several entities under common column names, typed nulls where one has no such column."""
    parts = [df.select(F.lit(name).alias(kind), *[F.col(a).alias(b) for b, a in columns.items()]) for name, df, columns in frames]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def concatenated(*frames: DataFrame, rank: str = "SOURCE_RANK") -> DataFrame:
    """Rows of typed lists one behind the other: ``rank`` says which list a row is from, missing columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn(rank, F.lit(i)) for i, df in enumerate(frames)])


def matching_type(df: DataFrame, column: str, value, labels: dict | None = None) -> Column:
    """``column = value`` if the value's type fits the column's; a label is first mapped to its code. Otherwise a TypeError, not a silent cast."""
    if labels is not None:
        if value not in labels:
            raise TypeError(f"{value!r} is no label of {column}")
        value = labels[value]
    kind = df.schema[column].dataType.typeName()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    numeric = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
    if value is not None and (numeric != number or kind == "boolean" and not isinstance(value, bool)):
        raise TypeError(f"{column} is {kind}, not {type(value).__name__}")
    return F.col(column) == F.lit(value)


def first_table_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a``, and rows of ``b`` whose key ``a`` lacks."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"), allowMissingColumns=True)


def chronological(date: Column, year: Column) -> list[Column]:
    """Full date, else the year's start; undated last."""
    key = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-00-00")))
    return [key.asc_nulls_last()]


def fill_counts(keys: DataFrame, counted: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A count for every key, 0 where there is none."""
    c = counted.groupBy(key).agg(F.count("*").alias(name))
    return keys.join(c, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


@dataclass(frozen=True)
class Page:
    number: int = 1
    rows: int = PAGE

    @staticmethod
    def clamp(number: int | None, rows: int | None, default: int = PAGE, most: int = MOST) -> Page:
        return Page(max(1, number or 1), min(most, max(1, rows or default)))

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.rows


def merged_limit(page: Page, inner_limit: int | None = None, inner_offset: int = 0, compat: bool = False) -> tuple[int, int]:
    """(limit, offset) of a page within a query's own LIMIT; ``compat`` lets later pages run past it."""
    limit = page.rows if inner_limit is None else min(inner_limit, page.rows)
    if inner_limit is not None and not compat:
        limit = max(0, min(page.rows, inner_limit - page.offset))
    return limit, inner_offset + page.offset


def paginate(df: DataFrame, order: Sequence[Column], page: Page, inner_limit: int | None = None, inner_offset: int = 0, compat: bool = False) -> DataFrame:
    """One page: a top-k over limit + offset rows, not a full sort. End ``order`` with a unique column."""
    limit, offset = merged_limit(page, inner_limit, inner_offset, compat)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], page: Page, total: str = "total") -> DataFrame:
    """A page whose rows hold the number of all rows, from an aggregate (one row) beside the top-k; no rows past the end."""
    n = df.agg(F.count("*").alias(total))
    return paginate(df, order, page).crossJoin(F.broadcast(n))


def numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows as (index, data): for one page of results, not for whole tables."""
    return df.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("index"), F.struct(*df.columns).alias("data"))
