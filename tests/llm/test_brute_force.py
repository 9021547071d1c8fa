"""Whole queries, stages and the pipeline against plain Python or DuckDB, and tables with one dominating key."""

import collections
import itertools
import math
import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from starloom.llm import common, language_id, license_scan, line_dedup, minhash_dedup, mixture, url_filter
from starloom.llm.url_filter import OP6_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how, monkeypatch):
    """One key holds a third of the rows; null keys match nothing."""
    monkeypatch.setattr(common, "HOT", 8)
    r = random.Random(1)
    left = spark.createDataFrame([(i, 7 if i % 3 == 0 else None if i % 50 == 1 else r.randrange(200), "x") for i in range(3000)], "i long, k int, other string")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 200, 7)] + [(None, "none")], "k int, v string")
    hot = common.hot_keys(left, ["k"])
    assert [r[0] for r in hot.collect()] == [7]
    counted = common.hot_counted(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert [r[0] for r in counted.collect()] == [7]
    got = sorted(map(repr, common.salted_join(left, right, ["k"], how, hot=hot).select("i", *(["v"] if how in ("inner", "left") else [])).collect()))
    assert got == sorted(map(repr, left.join(right, "k", how).select("i", *(["v"] if how in ("inner", "left") else [])).collect()))
    assert common.hot_keys(left.where("false"), ["k"]) is None and common.hot_keys(left.where("k <> 7").distinct(), ["i"]) is None


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUBS", 0)
    monkeypatch.setattr(common, "HOT", 4)
    edges = [(i, 1000) for i in range(500)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000, 5000), (3001, 3000)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(500)}, 1000: 0, **{i: 2000 for i in range(2000, 2041)}, 3000: 3000, 3001: 3000, **({5000: 5000} if 5000 in got else {})}


def test_lines_of_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = [(i, "\n".join([f"a line of document {i}", "The line that all hold", "short", "a line of document 3"][: 2 + i % 3])) for i in range(300)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    first: dict[str, int] = {}
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            k = x.strip().lower()
            holders[k].add(i)
            first.setdefault(k, i)
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(x.strip()) < 10 or len(holders[x.strip().lower()]) < 2 or first[x.strip().lower()] == i]
        assert got[i] == ("\n".join(kept), len(lines), len(lines) - len(kept))


def _pages(n=900):
    r = random.Random(4)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            u = None if i % 12 == 0 else "nothing here"
        elif kind == 1:
            u = f"https://www.site{r.randrange(60)}.example.net/en/{r.choice(['news', 'guide', 'story'])}-{r.randrange(90)}"
        elif kind == 2:
            u = f"http://x{r.randrange(60)}.net/{r.choice(['buy', 'cheap', 'win'])}/{r.randrange(99)}?q=1"
        elif kind == 3:
            u = f"https://m{r.randrange(40)}.example.com/de/{r.choice(['cheap', 'win'])}#{r.randrange(9)}"
        else:
            u = f"https://{r.choice(['good', 'bad', 'other'])}{r.randrange(20)}.com/{r.choice(['news', 'cheap', 'guide', 'win'])}/{r.randrange(60)}"
        out.append((i, u))
    return out


def test_url_verdicts(spark, tmp_path):
    """Verdicts of urls that no rule fits, the threshold among them, against plain Python; a third of the urls has no host."""
    rows = _pages()
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    import hashlib
    import re

    def parts(u):
        at = (u or "").find("://")
        rest = u[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(h, p):
        fit = [x for x in url_filter.RULES if (h == x.split("/", 1)[0] or h.endswith("." + x.split("/", 1)[0])) and p.startswith("/" + x.split("/", 1)[1])]
        return max(fit, key=len, default=None)

    sites = {parts(u) for _, u in rows}
    grams = lambda s: [("^^^^" + s + "$")[i : i + 5] for i in range(len(s) + 1)]
    unseen = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:6], 16) % 5 == 0
    counts = {v: collections.Counter() for v in ("allow", "block")}
    for h, p in sites:
        if rule(h, p) and not unseen(h + p):
            for g in grams(h + p):
                for k in range(5):
                    counts[url_filter.RULES[rule(h, p)]][g[4 - k :]] += 1
    follow = {v: collections.defaultdict(collections.Counter) for v in counts}
    for v, c in counts.items():
        for g, n in c.items():
            follow[v][g[:-1]][g[-1]] = n

    def chance(v, g):
        x = 1 / 256
        for k in range(5):
            f = follow[v].get(g[4 - k : 4])
            if f:
                x = (f[g[4]] + len(f) * x) / (sum(f.values()) + len(f))
        return x

    score = {s: float(np.mean([math.log(chance("allow", g)) - math.log(chance("block", g)) for g in grams("".join(s))])) for s in sites}
    held = {v: [score[s] for s in sites if rule(*s) and url_filter.RULES[rule(*s)] == v and unseen("".join(s))] for v in counts}
    threshold = (np.mean(held["allow"]) + np.mean(held["block"])) / 2
    for i, u in rows:
        s = parts(u)
        want = url_filter.RULES[rule(*s)] if rule(*s) else "allow" if score[s] >= threshold else "block"
        assert got[i].verdict == want, (u, score[s], threshold)
    assert {got[i].verdict for i, u in rows if not rule(*parts(u))} == {"allow", "block"}
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[4] for r in con.execute(OP6_SQL).fetchall()} == {i: r.verdict for i, r in got.items()}


def test_more_languages_than_a_word_has_bits(spark):
    """70 languages of own syllables; tags, private use and combining marks are no letters, letters of high planes are."""
    r = random.Random(6)
    syllables = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join("".join(r.choice(syllables[k]) for _ in range(2)) for _ in range(25)), k) for i, k in enumerate(sorted(syllables) * 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(language_id.fold() != 0))
    assert model.table.shape[1] == 2
    got = {x.doc_id: x.lang_pred for x in language_id.predict(df, model).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == k for i, k in held) >= 0.99 * len(held)
    odd = spark.createDataFrame([(1, "\U000e0041\U000e0042"), (2, "  12"), (3, "́̂"), (4, "\U00020000"), (5, "\U0001d400")], "doc_id long, text string")
    got = {x.doc_id: x.lang_pred for x in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and "und" not in (got[4], got[5])


def test_language_accuracy_against_plain_sets(spark):
    """Held-out accuracy on real rows is at least that of a model that keeps whole sets of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = language_id.fit(docs.where(language_id.fold() != 0))
    pred = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    letters = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t)
    grams = lambda t: [x[i : i + 4] for x in [" " + " ".join(letters(t).split()) + " "] for i in range(len(x) - 3)]
    counts = collections.defaultdict(collections.Counter)
    for i, t, k in rows:
        if not held(i):
            counts[k].update(grams(t))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    top = collections.defaultdict(float)
    for c in rate.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    sets = {k: {g for g, x in c.items() if x >= language_id.SHARE * top[g] and counts[k][g] >= language_id.LEAST} for k, c in rate.items()}
    test = [(i, t, k) for i, t, k in rows if held(i)]
    plain = sum(max(sorted(sets), key=lambda s: sum(g in sets[s] for g in grams(t))) == k for i, t, k in test) / len(test)
    mine = sum(pred[i] == k for i, t, k in test) / len(test)
    print(f"held-out accuracy {mine:.4f}, plain sets {plain:.4f}, {len(test)} documents")
    assert mine >= plain - 0.01 and mine > 0.9


def test_licenses_against_all_windows(spark):
    """Every template against every window by a full longest common subsequence: the same templates are found, with the same number of words."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("bcdfghklm") + r.choice("aeiou") for _ in range(n))
    templates = {f"T{k}": " ".join(word(r.randint(2, 4)) for _ in range(32 + 4 * k)) for k in range(3)}
    assert all(len(t.split()) > license_scan.BAND for t in templates.values())
    docs = []
    for i in range(36):
        name = f"T{i % 3}"
        w = templates[name].split()
        for _ in range(i % 12):  # 0 to 11 edits: some stay above the least coverage, some fall below
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [word(3)], [w[at], word(2)]])
        docs.append((i, " ".join([*(word(2) for _ in range(i % 7)), *w, *(word(2) for _ in range(i % 5))]) if i % 9 else None if i else ""))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    got = {x.doc_id: {(m.template, m.matched) for m in x.matches} for x in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    found = 0
    for i, t in docs:
        w = (t or "").split()
        best = {n: max((lcs(x.split(), w[a : a + len(x.split()) + license_scan.BAND]) for a in range(max(1, len(w) - len(x.split()) + 1))), default=0) for n, x in templates.items()}
        assert got[i] == {(n, m) for n, m in best.items() if m >= license_scan.COVERAGE * len(templates[n].split())}, i
        found += len(got[i])
    assert found > 15
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string, matches int")).count() == 0


def _documents():
    r = random.Random(21)
    word = lambda: "".join(r.choice(["ba", "ko", "ti", "re", "lu", "na"]) for _ in range(r.randint(1, 3)))
    base = ["\n".join(" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = list(base)
    for t in base[:15]:  # near copies on one line, so that line dedup leaves them
        w = t.replace("\n", " ").split(" ")
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), " ".join(w) + " end"]
    texts += ["The footer that all share\n" + t for t in base[15:25]] + [base[3], base[3], "12 34 !!", "", None, "\n\n", "The footer that all share"]
    return [(None if i == 70 else i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", "s2", "web"]), len(t or "")) for i, t in enumerate(texts)]


def test_pipeline_against_plain_python(spark, tmp_path):
    import sentencepiece

    rows = _documents()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.text_crc32, r.restored) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # language ID: what has no letter goes
    docs = [d for d in rows if d[1] and any(c.isalpha() for c in d[1])]
    # line dedup: in the smallest id only; documents that lose every line go
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(set)
    for i, t, *_ in docs:
        if i is not None:
            for x in t.split("\n"):
                holders[key(x)].add(i)
    kept = []
    for i, t, lang, source, _ in docs:
        lines = t.split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        if stay:
            t = "\n".join(stay)
            kept.append((i, t, lang, source, len(t)))
    # MinHash: the smallest id of each component of exact similarities of at least 0.75
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t, *_ in kept if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = [d for d in kept if d[0] is None or find(d[0]) == d[0]]
    assert len(kept) < len(docs) - 20
    # mixture: its SQL on what is left
    spark.createDataFrame(kept, kind).coalesce(1).write.parquet(f"{tmp_path}/left.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/left.parquet/*.parquet'")
    uses = collections.Counter(r[0] for r in con.execute(mixture.OP5_SQL.replace("CAST(doc_id AS VARCHAR)", "coalesce(CAST(doc_id AS VARCHAR), '')")).fetchall())
    # SentencePiece: the library's ids
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for i, t, *_ in kept:
        ids = sp.encode(t)
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(t.encode()), True)] += uses[i]
    assert got == +want


def test_stages_on_nothing_and_on_repeated_rows(spark):
    """Every stage on an empty table, on nulls in any column and on equal rows; all but the last keep the columns."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some words that stand twice here", "en", "s", 32)] * 2 + [(2, None, None, None, None), (None, "another text without an id at all", None, "s", 33), (3, "x" * 20000 + " y", "en", None, None)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], kind), "").count() == 0, name
        out = stage(spark, spark.createDataFrame(rows, kind), "")
        if name != "SentencePiece":
            assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.collect() is not None
    assert len(corpus_pipeline.minhash(spark, spark.createDataFrame(rows, kind), "").collect()) == 5


def test_minhash_of_one_large_group(spark, monkeypatch):
    """A third of all documents are near copies of one text, another third exact ones."""
    monkeypatch.setattr(common, "HOT", 8)
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        if i % 3 == 0:
            w[r.randrange(60)] = f"new{i}"
        elif i % 3 == 1:
            w = [f"u{i}_{k}" for k in range(20)]
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i % 3 == 1 else 0 for i in range(240)}
