"""URL filters: host and path rules first, then a language-model ratio, in DataFrame functions only.

Two variable-order Markov models over characters are counted, one on URLs that
rules allow and one on URLs that rules block. The chance of a character mixes
all orders up to ``ORDER`` by Witten-Bell weights: the more different characters
followed a context, the more the shorter context counts. The verdict compares
the mean log-ratio for each character with a threshold, the middle between the
two classes' means on labelled URLs that the models did not see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import hot_counted, hot_keys, materialise, salted_join

ORDER = 4
#: Rules (host/path, verdict); production values of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: then up to ``?``, ``#``; else empty."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts with its path; ties by name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p)), F.lit(rule)).otherwise(out)
    return out


def grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of host and path and the end mark: the ``ORDER`` characters in front and itself."""
    s = F.concat(F.lit("^" * ORDER), "host", "path", F.lit("$"))
    x = df.select(*keep, s.alias("s"))
    return x.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - ORDER), lambda i: F.substr(F.col("s"), i, F.lit(ORDER + 1)))).alias("g"))


def char_models(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of both classes (good: 1 or 0) for suffixes of grams, and number and variety of what follows a context."""
    g = grams(labelled, "good").groupBy("g").agg(F.sum("good").cast("long").alias("na"), F.sum(1 - F.col("good")).cast("long").alias("nr"))
    k = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    n = g.select("g", "na", "nr", k).groupBy(F.substr("g", ORDER + 1 - F.col("k")).alias("gram"), "k").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    n = materialise(n, "gram-counts")
    c = n.groupBy(F.expr("left(gram, k)").alias("ctx"), "k").agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nr") > 0).alias("tr"))
    return n, materialise(c, "context-counts")


def gram_scores(wanted: DataFrame, n: DataFrame, c: DataFrame) -> DataFrame:
    """(g, s): log-ratio of the two models for each distinct gram in ``wanted``."""
    x = wanted.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
    x = x.withColumn("gram", F.substr("g", ORDER + 1 - F.col("k"))).withColumn("ctx", F.expr("left(gram, k)"))
    x = x.join(n, ["gram", "k"], "left").join(c, ["ctx", "k"], "left").na.fill(0, ["na", "nr", "ca", "cr", "ta", "tr"])
    per = x.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "na", "nr", "ca", "cr", "ta", "tr"))).alias("o"))

    def chance(n_: str, c_: str, t_: str) -> Column:
        step = lambda p, o: F.when(o[c_] > 0, (o[n_] + o[t_] * p) / (o[c_] + o[t_])).otherwise(p)
        return F.aggregate("o", F.lit(1 / 256), step)

    return per.select("g", (F.ln(chance("na", "ca", "ta")) - F.ln(chance("nr", "cr", "tr"))).alias("s"))


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path and fit no
    rule; the models judge them by their end mark. URLs that no rule fits are
    allowed if their score is at least the threshold; without labelled URLs of
    both classes all of them are allowed. Repeated rows get equal verdicts;
    other columns are not read.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col).cast("string"))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    good = F.lit(None).cast("int")
    for rule, verdict in rules.items():
        good = F.when(F.col("rule") == rule, 1 if verdict == "allow" else 0).otherwise(good)
    p = p.withColumn("good", good)
    sites = p.groupBy("host", "path").agg(F.first("good").alias("good"), F.count("*").alias("pages"))
    sites = materialise(sites.withColumn("site", F.monotonically_increasing_id()), "sites")
    unseen = F.conv(F.substr(F.md5(F.concat("host", "path")), F.lit(1), F.lit(6)), 16, 10).cast("int") % 5 == 0
    n, c = char_models(sites.where(F.col("good").isNotNull() & ~unseen))
    judged = sites.where(F.col("good").isNull() | unseen)
    mine = materialise(grams(judged, "site"), "site-grams")
    scored = salted_join(mine, gram_scores(mine, n, c), ["g"], columns=["site"], hot=hot_keys(mine, ["g"]))
    scores = scored.groupBy("site").agg(F.avg("s").alias("score"))
    scores = materialise(sites.select("site", "host", "path", "good", "pages").join(scores, "site"), "scores")
    means = {r["good"]: r["m"] for r in scores.where("good IS NOT NULL").groupBy("good").agg(F.avg("score").alias("m")).collect()}  # two rows
    threshold = (means[0] + means[1]) / 2 if len(means) == 2 else float("-inf")
    # urls without a host are one site
    out = salted_join(p, scores.where("good IS NULL").select("host", "path", "score"), ["host", "path"], "left", columns=["page_id"], hot=hot_counted(sites, ["host", "path"], "pages"))
    verdict = F.when(F.col("good") == 1, "allow").when(F.col("good") == 0, "block").when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("score")


def _chance(n: str, c: str, t: str) -> str:
    """The mixed chance as SQL, from columns of all orders."""
    out = "(1.0 / 256)"
    for k in range(ORDER + 1):
        out = f"(CASE WHEN coalesce({c}{k}, 0) > 0 THEN (coalesce({n}{k}, 0) + {t}{k} * {out}) / CAST({c}{k} + {t}{k} AS DOUBLE) ELSE {out} END)"
    return out


_K = range(ORDER + 1)
#: The same in SQL for DuckDB.
OP6_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
s AS (SELECT host, path, CASE any_value(rule) WHEN 'net/' THEN 0 WHEN 'example.com/de/' THEN 0 WHEN 'example.net/en/' THEN 1 WHEN 'org/fr/' THEN 1 END AS good, CAST('0x' || substr(md5(host || path), 1, 6) AS INT) % 5 = 0 AS unseen FROM r GROUP BY host, path),
g AS (SELECT host, path, good, unseen, substr('{"^" * ORDER}' || host || path || '$', i, {ORDER + 1}) AS g FROM (SELECT *, unnest(range(1, length(host) + length(path) + 2)) AS i FROM s)),
n AS (SELECT substr(g, {ORDER + 1} - k) AS gram, k, sum(good) AS na, sum(1 - good) AS nr FROM g, range({ORDER + 1}) t(k) WHERE good IS NOT NULL AND NOT unseen GROUP BY 1, 2),
c AS (SELECT left(gram, k) AS ctx, k, sum(na) AS ca, sum(nr) AS cr, count(*) FILTER (WHERE na > 0) AS ta, count(*) FILTER (WHERE nr > 0) AS tr FROM n GROUP BY 1, 2),
w AS (SELECT DISTINCT g FROM g WHERE good IS NULL OR unseen),
j AS (SELECT g, {", ".join(f"max(CASE WHEN k = {k} THEN {x} END) AS {x}{k}" for k in _K for x in ("na", "nr", "ca", "cr", "ta", "tr"))}
  FROM (SELECT w.g, t.k, n.na, n.nr, c.ca, c.cr, c.ta, c.tr FROM w CROSS JOIN range({ORDER + 1}) t(k) LEFT JOIN n ON n.gram = substr(w.g, {ORDER + 1} - t.k) AND n.k = t.k LEFT JOIN c ON c.ctx = left(substr(w.g, {ORDER + 1} - t.k), t.k) AND c.k = t.k) GROUP BY g),
o AS (SELECT g, ln({_chance("na", "ca", "ta")}) - ln({_chance("nr", "cr", "tr")}) AS s FROM j),
m AS (SELECT host, path, any_value(good) AS good, avg(s) AS score FROM g JOIN o USING (g) WHERE good IS NULL OR unseen GROUP BY host, path),
t AS (SELECT CASE WHEN count(DISTINCT good) = 2 THEN (avg(score) FILTER (WHERE good = 0) + avg(score) FILTER (WHERE good = 1)) / 2 ELSE '-inf'::DOUBLE END AS threshold FROM m WHERE good IS NOT NULL)
SELECT page_id, r.host, r.path, rule, CASE WHEN s.good = 1 THEN 'allow' WHEN s.good = 0 THEN 'block' WHEN score >= threshold THEN 'allow' ELSE 'block' END AS verdict
FROM r JOIN s ON s.host = r.host AND s.path = r.path LEFT JOIN m ON m.host = r.host AND m.path = r.path CROSS JOIN t
"""
