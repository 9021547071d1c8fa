"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A budget of tokens flows down a tree domain - language - source. At each node it
is split by integer weights; a child gets no more than its subtree can give (its
tokens times ``max_epochs``), and what it can't use goes to its siblings by
weight. A node whose children are all exhausted was given no more than that, so
shortages reach an ancestor's other branches only when the siblings are full.
A leaf whose budget is e whole epochs and a rest gives all documents e times and
the rest as a prefix of the next epoch's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.llm.common import materialise

LEVELS = ["domain", "language", "source"]
#: Weights; what isn't named has weight 1. Sums over siblings must stay below 10,000.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "es": 2, "fr": 2}
#: Budget as a share of all tokens, in thousandths; the most times a document may be used; the seed.
SHARE, MAX_EPOCHS, SEED = 600, 3, "mix"
#: Hexadecimal digits of the order key that are summed before single documents are looked at.
DIGITS = 3


def domain_of(source: Column) -> Column:
    """Sources belong to four domains by the number at their end."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number != "", number.cast("int") % 4).otherwise(0).cast("string"))


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``budget`` to rows with (parents..., child, cap, w, given): ``given`` split by ``w``, nobody above ``cap``.

    Children in the order of cap / w are full as long as their cap is at most
    their share of what is left; the others share the rest by cumulated,
    rounded weights, which loses no token. Sums of sibling rows only.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("cap") / F.col("w")).asc(), F.col(child).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    x = children.withColumn("have", F.least(F.col("given"), F.sum("cap").over(by)))
    x = x.withColumn("full", F.col("cap") * F.sum("w").over(after) <= (F.col("have") - F.coalesce(F.sum("cap").over(before), F.lit(0))) * F.col("w"))
    x = x.withColumn("rest", F.col("have") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
    open_w = F.when(~F.col("full"), F.col("w"))
    x = x.withColumn("open", F.sum(open_w).over(by)).withColumn("upto", F.coalesce(F.sum(open_w).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    share = F.expr("(rest * upto) div open - (rest * (upto - w)) div open")
    return x.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share)).drop("have", "full", "rest", "open", "upto")


def leaf_budgets(leaves: DataFrame, share: int, max_epochs: int, weights: dict[str, dict[str, int]], target: int | None = None) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens); empty leaves get 0."""
    level = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    given = total.select((F.lit(target) if target is not None else F.expr(f"(all * {share}) div 1000")).cast("long").alias("given"))
    for depth, name in enumerate(LEVELS):
        keys, parent = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = level.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight(name, weights.get(name, {})))
        nodes = nodes.join(given, parent) if parent else nodes.crossJoin(F.broadcast(given))  # one row
        given = split_budget(nodes, parent, name).select(*keys, F.col("budget").alias("given"))
    return leaves.join(given, LEVELS).withColumnRenamed("given", "budget")


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, leaf and number of words of every row; nulls of language and source are leaves ``''``."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source"), words.alias("n_tokens")).withColumn("domain", domain_of(F.col("source")))


def select_mixture(docs: DataFrame, share: int = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] | None = None, target: int | None = None) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, epoch): a row for each use of a document.

    Documents without words and leaves without tokens are never chosen. Rows of
    one id in one leaf are told apart by nothing and chosen in turn. The order
    key of epoch e is md5(seed:e:doc_id); ties by id.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS}
    p = materialise(profile(docs).where("n_tokens > 0"), "profile")
    leaves = p.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, share, max_epochs, weights, target).select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part"))
    plan = materialise(plan, "plan")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    x = p.join(plan, LEVELS).withColumn("key", key).withColumn("bin", F.substring("key", 1, DIGITS))
    # at most 16 ** DIGITS sums for each leaf
    bins = x.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("s"), F.first("part").alias("part"))
    upto = F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    cut = bins.withColumn("upto", upto).where("upto > part").groupBy(*LEVELS).agg(F.min("bin").alias("cut"), F.min(F.struct("bin", (F.col("part") - F.col("upto") + F.col("s")).alias("rest"))).alias("m"))
    cut = materialise(plan.join(cut.select(*LEVELS, "cut", F.col("m.rest").alias("rest")), LEVELS), "cut")
    y = p.join(cut, LEVELS).withColumn("key", key).withColumn("bin", F.substring("key", 1, DIGITS))
    edge = y.where("bin = cut").withColumn("at", F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["doc_id", *LEVELS, "n_tokens"]
    last = y.where("bin < cut").select(*cols, F.col("whole").cast("int").alias("epoch")).unionByName(edge.where("at <= rest").select(*cols, F.col("whole").cast("int").alias("epoch")))
    full = y.where("whole > 0").select(*cols, F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("epoch"))
    return full.unionByName(last)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, as often as they are chosen; all rows of a chosen id."""
    chosen = select_mixture(docs, **options).select(F.col("doc_id").alias("_chosen"), "epoch").distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("_chosen"))).select(*[docs[c] for c in docs.columns])


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level_sql(name: str, parent: list[str], w: str, given: str) -> str:
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, name])
    source = f"(SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY {keys})"
    join = f"JOIN {given} g USING ({', '.join(parent)})" if parent else f"CROSS JOIN {given} g"
    order = f"ORDER BY cap / w, {name}"
    return f"""
{name}_n AS (SELECT {", ".join(f"n.{k}" for k in [*parent, name])}, n.cap, g.given, CAST({w} AS BIGINT) AS w FROM {source} n {join}),
{name}_a AS (SELECT *, least(given, sum(cap) OVER ({by})) AS have, sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after, coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before FROM {name}_n),
{name}_b AS (SELECT *, cap * w_after <= (have - cap_before) * w AS is_full FROM {name}_a),
{name}_c AS (SELECT *, have - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0) AS rest, sum(w) FILTER (WHERE NOT is_full) OVER ({by}) AS open_w, coalesce(sum(w) FILTER (WHERE NOT is_full) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto FROM {name}_b),
{name}_g AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE (rest * upto) // open_w - (rest * (upto - w)) // open_w END AS BIGINT) AS given FROM {name}_c)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


#: The same in SQL for DuckDB.
OP5_SQL = rf"""
WITH p AS (
  SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS cap FROM p WHERE n_tokens > 0 GROUP BY ALL
), top AS (SELECT CAST(sum(tokens) * {SHARE} // 1000 AS BIGINT) AS given FROM leaves),
{_level_sql("domain", [], _case("n.domain", DOMAIN_WEIGHTS), "top")},
{_level_sql("language", ["domain"], _case("n.language", LANGUAGE_WEIGHTS), "domain_g")},
{_level_sql("source", ["domain", "language"], "1", "language_g")},
x AS (SELECT p.*, given // tokens AS whole, given % tokens AS part FROM p JOIN leaves USING (domain, language, source) JOIN source_g USING (domain, language, source) WHERE n_tokens > 0),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM x)
SELECT doc_id, domain, language, source, n_tokens, CAST(whole AS INT) AS epoch FROM y WHERE upto <= part
UNION ALL SELECT doc_id, domain, language, source, n_tokens, CAST(unnest(range(whole)) AS INT) AS epoch FROM x
"""
