"""A corpus pipeline of five stages, each one of the corpus operators.

Every stage takes and, but for the last, returns the columns of documents;
further columns are left out, and names of theirs clash with nothing. Texts are
read whole, however long. An empty table passes through all stages. The tests
hold the stages and the whole run against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import materialise
from starloom.llm.language_id import fit, fold, predict
from starloom.llm.line_dedup import dedup_lines
from starloom.llm.minhash_dedup import near_duplicates
from starloom.llm.mixture import mix_documents
from starloom.llm.sentencepiece_stream import round_trip

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that have no letter or no character gram of any language; gibberish with a single chance hit stays.

    Null and empty texts go, as they have no letter. Null ids and languages and
    repeated rows stay; the model learns from rows with id, text and language.
    """
    model = fit(docs.where(fold() != 0))
    found = predict(docs, model, keep=[F.col(c).alias(f"c{i}") for i, c in enumerate(COLUMNS)])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(COLUMNS)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; those that lose every line go.

    Null and empty texts are one empty line and stay, as an empty text. Repeated
    rows of an id count as one document; rows without an id keep all lines.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return out.where("n_dropped < n_lines").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, and all documents without an id, which link with nothing.

    Null and empty texts link with nothing and stay. All rows of a kept id stay.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    linked = docs.join(kept, docs["doc_id"] == F.col("_kept"), "left_semi")
    return linked.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for.

    Texts without words, null ones among them, are never chosen; null languages
    and sources are leaves of their own; ties of the seeded order go by id, rows
    of one id are chosen together.
    """
    return mix_documents(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's piece ids, and whether they decode to its text.

    Null texts count as empty, which has no ids. Repeated rows have a row each.
    """
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", minhash), ("mixture", mixture), ("SentencePiece", sentencepiece)]

#: Bloom filters and SentencePiece have no SQL form; a test holds the whole run against plain Python, the library and the mixture's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
