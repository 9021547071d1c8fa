"""Stages of the corpus pipeline on small tables."""

import corpus_pipeline


def rows(spark, *given):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")


def test_minhash_keeps_documents_without_id(spark):
    text = " ".join(f"word{i}" for i in range(80))
    d = rows(spark, (1, text), (2, text), (None, text), (None, "another text that has no id"), (None, None), (3, "a text of its own"))
    got = corpus_pipeline.minhash(spark, d, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, ""), (0, text), (0, "another text that has no id"), (1, text), (3, "a text of its own")])


def test_language_id_rejects_only_what_has_no_hits(spark):
    """Six languages of the same words share all hits, so that the best one holds a sixth of them."""
    text = "several common words that every language of this small table holds alike and again"
    given = [(i, text, f"l{i % 6}", "s", len(text)) for i in range(240)] + [(300, "12 34", "l0", "s", 5), (301, None, "l0", "s", 0)]
    d = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, d, "").collect()) == list(range(240))
