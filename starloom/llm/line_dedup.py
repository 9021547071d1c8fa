"""Line dedup: lines that several documents hold stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import hot_counted, materialise, salted_join

#: Stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    """The form in which lines are compared: stripped, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(doc, th, gone): th is the hash of the text; positions of the lines that go. Only two 64-bit hashes of a line are shuffled, never its text.

    Hashes are counted before they are sent (min and max of the document ids,
    a distinct count for other thresholds), so a line that every document
    holds costs one row for each task; when its rows look up the first document
    they are salted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "th", "pos", key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    hashed = keyed.select("doc", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k", F.char_length("k")).alias("h2"))
    if min_docs == 2:
        hot = hashed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    else:
        hot = hashed.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("doc").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= min_docs)
    hot = materialise(hot, "repeated-lines")
    return salted_join(hashed, hot.drop("n"), ["h1", "h2"], columns=["doc", "pos"], hot=hot_counted(hot, ["h1", "h2"], "n")).where("doc <> first").groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_lines and n_dropped.

    Null and empty texts are one empty line. Lines whose key is shorter than
    ``min_chars`` code points stay. Repeated rows of an id count as
    one document. A null id takes no part, its text stays. If all lines go the text is empty.
    """
    names = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in names else free("_" + c)  # noqa: E731  extra columns keep their names
    doc, th, gone, lines, n_lines, n_dropped = map(free, ("doc", "th", "gone", "lines", "n_lines", "n_dropped"))
    cut = dropped_lines(docs, id_col, text_col, min_docs, min_chars).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(cut, (docs[id_col] == F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left")
    cells = joined.withColumn(lines, F.split(text, "\n"))
    # positions that stay, by hashing: linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col(lines), p)), "\n"))
    return cells.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.array_size(lines).cast("long").alias(n_lines), F.coalesce(F.array_size(gone), F.lit(0)).cast("long").alias(n_dropped))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same in SQL for DuckDB.
OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, h.k IS NOT NULL AND doc_id <> first_doc AS gone FROM keyed LEFT JOIN hot h USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
