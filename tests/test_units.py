"""Literal cases of the text, matching, assertion and dialect functions."""

import pytest
from pyspark.sql import functions as F

from starloom.functions import matching, text
from starloom.operators import assertions, etl, questions
from starloom.operators.relational import Page, merged_limit
from starloom.plans import dialect


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value, want", [("star wars universe", "star wars"), ("collection", "collection"), ("série noire", "noire")])
def test_strip_words(spark, value, want):
    assert one(spark, value, text.strip_words) == want


@pytest.mark.parametrize("value, want", [("thrillers", "thriller"), ("comedies", "comedy"), ("documentaries", "documentary"), ("glass", "glass")])
def test_singularize(spark, value, want):
    assert one(spark, value, text.singularize) == want


@pytest.mark.parametrize("value, want", [("Star Wars Collection collection", "Star Wars Collection"), ("Dollars Trilogy collection", "Dollars Trilogy collection")])
def test_collapse_descriptor(spark, value, want):
    assert one(spark, value, text.collapse_descriptor) == want


def test_text_functions(spark):
    assert one(spark, "1.1.9", text.version_key) == "001.001.009"
    assert one(spark, " Where  is l’Œuvre ", text.normalize_question) == "Where is l'Œuvre"
    assert one(spark, "93784", text.duration_text) == "1 day, 2 hours, 3 minutes, 4 seconds"
    assert one(spark, "&amp;&#39;", text.html_unescape) == "&'"
    assert one(spark, "Élan  ﬁn", text.fold) == "elan fin"
    for value, want in (("김기덕", "Hangul"), ("黒澤 あ", "Japanese"), ("王家衛", "Chinese"), ("Тарковский", "Cyrillic"), ("Truffaut", "Latin"), (" ", ""), (None, "")):
        assert one(spark, value, text.script) == want


@pytest.mark.parametrize("value, want", [("16:9", "1.78"), ("4/3", "1.33"), ("2,39:1", "2.39"), ("1.77", None), ("1.89", None), ("1.90", None), ("Academy Ratio", "1.37"), (None, None)])
def test_aspect_ratio(spark, value, want):
    assert one(spark, value, etl.aspect_ratio) == want


def test_ratios():
    a, b = "mad max collection", "max und die wilde 7 collection"
    assert int(matching.weighted_ratio(a, b)) == 85 and int(matching.ratio(a, b)) == 62
    assert matching.weighted_ratio("", "x") == 0.0 and matching.ratio("abc", "abc") == 100.0


def test_cells_and_bridge(spark):
    df = spark.createDataFrame([(10, "x", 3.5), (20, "y", 4.5)], "A int, B string, C double").coalesce(1)
    order = [F.col("A")]
    for ok in ("CELL(0,0)==10", "CELL(1,0)==20", "CELL(0,1)=='x'", "CELL(1,2)>=4.5", "COUNT(*) == 2", "COUNT(A) >= 2 AND A > 5", "A IN (10, 20)", "B NOT IN ('z')"):
        assert assertions.check(df, ok, order), ok
    for bad in ("CELL(0,0)==999", "CELL(0,99)==1", "CELL(99,0)==1", "A IN (10, 30)", "A > 10", "NOPE > 1"):
        assert not assertions.check(df, bad, order), bad
    mixed = spark.createDataFrame([(5925, "Movie"), (999, "serie"), (76203, "movie")], "ID_CONTENT int, CONTENT_TYPE string")
    assert assertions.check(mixed, "ID_MOVIE IN (5925,76203)") and assertions.check(mixed, "ID_SERIE IN (999)")
    assert not assertions.check(mixed, "ID_SERIE IN (5925)") and assertions.check(mixed, "ID_MOVIE NOT IN (1,2,3)") and not assertions.check(mixed, "ID_MOVIE NOT IN (5925)")
    assert assertions.check(df.where("false"), "COUNT(*) == 0") and not assertions.check(df.where("false"), "A > 1")


def test_questions():
    assert questions.bare_id("tt0133093?") == ("title", "tt0133093") and questions.bare_id("q42") == ("item", "Q42") and questions.bare_id("who is it") is None
    spans = questions.align_spans("Tommy (1975) musicals", "{{Movie_title1}} ({{Release_year1}}) musicals", {"Movie_title1": "Tommy", "Release_year1": "1975"})
    closed = questions.align_spans("Tommy (1975) musicals", "Tommy (1975) {{Movie_genre1}}", {"Movie_genre1": "musicals"})
    assert questions.merge_passes("Tommy (1975) musicals", spans, closed) == ("{{Movie_title1}} ({{Release_year1}}) {{Movie_genre1}}", {"Movie_title1": "Tommy", "Release_year1": "1975", "Movie_genre1": "musicals"})
    unknown = questions.align_spans("Tommy (1975) musicals", "Tommy (1975) {{Genre1}}", {"Genre1": "musicals"})
    assert questions.merge_passes("Tommy (1975) musicals", spans, unknown)[0] == "{{Movie_title1}} ({{Release_year1}}) musicals"

    assert questions.pure_equality("SELECT * FROM m WHERE MOVIE_TITLE = 'Ocean''s Eleven'", "MOVIE_TITLE") == "Ocean's Eleven"
    assert questions.pure_equality("SELECT * FROM m WHERE MOVIE_TITLE = 'x' AND a = 1", "MOVIE_TITLE") is None
    c = questions.RuleCompiler()
    assert (c.compile("films of the 70s").year_from, c.compile("films of the 70s").year_to) == (1970, 1979)
    assert c.compile("movies since 2010").year_from == 2010 and c.compile("The Exorcist (1973)").year_to == 1974
    assert c.compile("movies by Agnes Varda and Jacques Demy").names == ["Agnes Varda", "Jacques Demy"]


def test_extraction_language():
    got = {"question": "{{Movie_title1}} ({{Release_year1}})", "Movie_title1": "Tommy", "Release_year1": "1975"}
    assert assertions.extraction_ok("eq('Movie_title1', 'Tommy') and eq('Release_year1', '1975') and keys('question', 'Movie_title1', 'Release_year1') and nonempty('question') and matches('Release_year1', '^19')", got)
    with pytest.raises(ValueError):
        assertions.extraction_ok("__import__('os')", got)


def test_dialect():
    assert dialect.rewrite("SELECT 1 FROM DUAL") == "SELECT 1"
    assert dialect.rewrite("SELECT a FROM t WHERE b = 'LIMIT 1, 2' LIMIT 5, 10;") == "SELECT a FROM t WHERE b = 'LIMIT 1, 2' LIMIT 10 OFFSET 5"
    with pytest.raises(dialect.NotReadOnly):
        dialect.rewrite("SELECT 1; DROP TABLE t")
    x = dialect.split_limit("SELECT (SELECT 1 LIMIT 3) FROM b LIMIT 20 OFFSET 5")
    assert (x.limit, x.offset) == (20, 5) and "LIMIT 3" in x.sql


def test_pages():
    assert Page.clamp(0, 900) == Page(1, 200) and Page.clamp(None, None) == Page(1, 50)
    assert merged_limit(Page(3, 10), 30, 5) == (10, 25) and merged_limit(Page(4, 10), 35, 0) == (5, 30)
    assert merged_limit(Page(5, 10), 35, 0) == (0, 40) and merged_limit(Page(5, 10), 35, 0, compat=True) == (10, 40)


def test_values_are_bound(spark):
    """Quotes, backslashes, dollars and comment marks in values mean nothing; literals keep what stands beside a placeholder."""
    from starloom.plans import engine

    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("bound_rows")
    run = lambda sql, **v: [tuple(r) for r in engine.run(spark, sql, v).collect()]
    for v in ("x\\' OR 1=1 -- ", "a\\", "' OR '1'='1", "x'; DROP TABLE bound_rows; --", "$a ${b} \\1", "/* a */ -- a", '"', "{{B1}}"):
        assert run("SELECT id FROM bound_rows WHERE name = '{{A1}}'", A1=v) == []
        assert run("SELECT '{{A1}}' AS x", A1=v) == [(v,)]
        assert run("SELECT 'l\\'eau: {{A1}}!' AS x", A1=v) == [(f"l'eau: {v}!",)]
    assert run("SELECT id FROM bound_rows WHERE id = {{N1}} AND name = {{A1}}", N1="2", A1="b") == [(2,)]
    assert run("SELECT '{{A1}}' AS x", A1=7) == [("7",)]
    with pytest.raises(engine.Ambiguous):
        engine.run(spark, "SELECT '{{IMDb_ID1}}' AS x", {"IMDb_ID1": "nm1"})


def test_repeated_changes_need_an_order(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="changed twice"):
        etl.upsert(t, twice, ["k"]).collect()
    assert [tuple(r) for r in etl.upsert(t, twice, ["k"], order=[F.col("v")]).collect()] == [(1, "c")]


def test_bank_over_jdbc(spark, tmp_path):
    """The database applies the predicate; Derby comes with Spark."""
    from starloom.sources import files

    url = f"jdbc:derby:{tmp_path}/bank;create=true"
    rows = [(1, 1, None, "COUNT(*) > 0"), (2, 0, None, "x > 1"), (3, 1, 1, "x > 1"), (4, 1, 0, " "), (5, 1, 0, "x > 1"), (6, None, 0, "x > 1")]
    spark.createDataFrame(rows, "ID int, IS_EVAL int, DELETED int, ASSERTIONS string").write.format("jdbc").option("url", url).option("dbtable", "BANK").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").option("createTableColumnTypes", "ASSERTIONS varchar(100)").save()
    got = files.read_bank_jdbc(spark, url, "BANK", key="ID", parts=2, low=1, high=6)
    assert sorted(r.ID for r in got.collect()) == [1, 5]


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_nearest_rank_in_bins(spark, p):
    import random

    r = random.Random(5)
    rows = [("a", r.choice([0.0, 1e9, -3.5, r.random()])) for _ in range(500)] + [("b", 7.0)] * 20 + [("c", None), ("d", 1e308), ("d", -1e308), (None, 3.0)]
    from starloom.operators.relational import nearest_rank

    got = {x.k: x.value for x in nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", p, ["k"]).collect()}
    for k in ("a", "b", "d"):
        v = sorted(y for x, y in rows if x == k)
        assert got[k] == v[min(len(v) - 1, round(p * (len(v) - 1)))]
    assert "c" not in got
