"""Each corpus operator on small tables with nulls, empty and repeated rows, against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from starloom.llm import common, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, mixture, pivot_index, sentencepiece_stream, token_store, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "é", "ß"]) for _ in range(r.randint(1, 4)))
    out = [" ".join(word() for _ in range(r.randint(6, 60))) for _ in range(n // 3)]
    near = []
    for t in out:
        w = t.split(" ")
        w[r.randrange(len(w))] = word()
        near.append(" ".join(w))
    return [None, "", " \n\t ", "one two", "a  b\n c é <|endoftext|> ▁x", "Same line of text here\nother\nSame line of text here", "same LINE of text here \nx", *out, *near, *out[:5], "word " * 3000]


def docs(spark, extra=True):
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", "s", None][i % 4], "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc string").repartition(3)


def empty(spark):
    return docs(spark).where("false")


def test_token_store(spark):
    path = common.scratch(spark, "t")
    d = docs(spark)
    token_store.write_store(d, path, P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, got = 0, {r.doc_id: r for r in token_store.read_digest(spark, path).collect()}
    back = {r.doc_id: r.ids for r in token_store.read_documents(spark, path).collect()}
    for i, t in enumerate(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert back[i] == ids
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].verified) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    names = [r.hash for r in spark.read.parquet(f"{path}/chunks").collect()]
    assert len(names) == len(set(names))
    token_store.write_store(empty(spark), path2 := common.scratch(spark, "e"), P.path("byte_bpe_50k.json"))
    assert token_store.read_digest(spark, path2).count() == 0


def test_crc_behind():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"hello" * 50, b"world" * 33)):
        assert int(token_store.crc_behind(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_token_store_files_in_order(spark):
    """Several files, one chunk that a third of all documents hold, clashing columns, repeated and null ids."""
    r = random.Random(8)
    same = " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(900))
    rows = [(None if i == 7 else 5 if i in (5, 6) else i, same if i % 3 == 0 else f"text {i} " + "".join(r.choice("abcdef ") for _ in range(400)), "x", 1) for i in range(1500)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string, hash string, seq int").repartition(7)
    path = common.scratch(spark, "t")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        token_store.write_store(d, path, P.path("byte_bpe_50k.json"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    import glob

    import pyarrow.parquet as pq

    for table, key in (("manifest", ["doc_id", "row_id"]), ("recipes", ["doc_id", "row_id", "seq"])):
        files = sorted(glob.glob(f"{path.removeprefix('file:')}/{table}/part-*"))
        assert len(files) > 1
        seen = [tuple(-1 if x is None else x for x in k) for f in files for k in zip(*(pq.read_table(f, columns=[c]).column(0).to_pylist() for c in key), strict=True)]
        assert seen == sorted(seen) and len(seen) == len(set(seen))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.verified) for r in token_store.read_digest(spark, path).collect())
    start = 0
    for at, _, n, _, ok in got:
        assert at == start and ok
        start += n
    crc = sorted(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t, *_ in rows)
    assert sorted(x[3] for x in got) == crc


def test_token_parts_equal_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    memo = token_store.WordMemo(tok, False)
    assert not memo.whole
    r = random.Random(5)
    marks = ["a", "b", "Z", "é", "я", "ა", "'", "'s", " ", "  ", "\n", "\n\n", " \n", "\t", "1", "²", "½", ".", "@", "-", "—", "😀", "<|endoftext|>", "\u00a0", "\r", "\x00", "]", "^", "\u0301", "\x85", "中"]
    odd = ["".join(r.choice(marks) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    assert [np.frombuffer(x, memo.kind).tolist() for x in memo.encode(odd)] == [x.ids for x in tok.encode_batch(odd, add_special_tokens=False)]
    other = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    memo = token_store.WordMemo(other, False)
    assert memo.whole
    assert [np.frombuffer(x, memo.kind).tolist() for x in memo.encode(odd[:200])] == [x.ids for x in other.encode_batch(odd[:200], add_special_tokens=False)]


def vectors(spark, n=300):
    r = np.random.default_rng(3)
    base = r.normal(size=(n, 8)).astype("float32")
    base[50:60] = base[:10]
    base[60:90] = base[0] + 0.02 * r.normal(size=(30, 8))
    rows = [(i, [float(x) for x in v], i % 3 if i % 17 else None) for i, v in enumerate(base)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 8, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [None] + [1.0] * 7, 1), (200, [float(x) for x in base[5]], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_topk(spark):
    rows, df = vectors(spark)
    good = [(i, np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    got = collections.defaultdict(list)
    for r in pivot_index.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (0, 100):
        v = dict(good)[q]
        assert got[q] == sorted(((i, int(v @ x)) for i, x in good if i != q), key=lambda p: (-p[1], p[0]))[:10]
    assert pivot_index.top_k(df.where("false")).count() == 0


def clustered(spark, dim=64, n=900):
    """Vectors of ``dim`` dimensions: clusters, copies within 0.98 of each other, equal ones, clashing columns."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, dim))
    v = centres[r.integers(0, 12, n)] + 0.6 * r.normal(size=(n, dim))
    v[300:420] = v[r.integers(0, 60, 120)] + 0.08 * r.normal(size=(120, dim))
    v[420:440] = v[3]
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype("float32")
    rows = [(i, [float(x) for x in a], i % 2, "a", 1, i) for i, a in enumerate(v)]
    return v.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, block int, g long").repartition(5)


def test_topk_in_blocks(spark, monkeypatch):
    """64 dimensions, several blocks of queries and of vectors an annulus; clusters let the bounds skip pairs."""
    v, df = clustered(spark)
    w = np.floor(1024 * v).astype(np.int64)
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "QUERIES", 3)
    rows = df.select("vec_id", pivot_index.whole_numbers("embedding").alias("v"))
    index = pivot_index.PivotIndex(rows)
    q = rows.where("vec_id % 30 = 0").select(pivot_index.F.col("vec_id").alias("query_id"), pivot_index.F.col("v").alias("q"))
    got = collections.defaultdict(list)
    for r in index.search(q, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 30))
    for i in got:
        assert got[i] == sorted(((j, int(w[i] @ w[j])) for j in range(900) if j != i), key=lambda p: (-p[1], p[0]))[:10]
    assert 0 < index.compared(30) < 1
    few = {r.query_id for r in pivot_index.top_k(df.where("vec_id < 4"), every=2).collect()}
    assert few == {0, 2}


def test_near_vectors_in_tiles(spark, monkeypatch):
    """64 dimensions, so that suffix norms stop pairs; many tiles, cells cut along further axes."""
    v, df = clustered(spark)
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.arange(900)[:, None] % 2 == np.arange(900)[None, :] % 2)
    np.fill_diagonal(link, False)
    root = np.arange(900)
    while True:
        new = np.minimum(root, np.array([root[x].min() if x.any() else 900 for x in link]))
        if (new == root).all():
            break
        root = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(900)}
    assert link.sum() > 300


def test_near_vectors(spark):
    rows, df = vectors(spark)
    rows, df = rows[:-1], df.where("NOT (vec_id = 200 AND label = 2 AND embedding[0] = 0)").dropDuplicates(["vec_id"])
    kept = {r.vec_id: (r.embedding, r.label) for r in df.collect()}
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, (v, l) in kept.items() if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = collections.Counter()
    par = {i: i for i in kept}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sorted(ok), 2):
        if kept[a][1] == kept[b][1] and ok[a] @ ok[b] >= 0.98:
            links.update((a, b))
            x, y = sorted((find(a), find(b)))
            par[y] = x
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i in kept}
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_line_dedup(spark):
    rows = {i: t for i, t in enumerate(texts())}
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows.items():
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                holders[key(s)].add(i)
    out = line_dedup.dedup_lines(docs(spark))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "doc"]
    for r in out.collect():
        lines = (rows[r.doc_id] or "").split("\n")
        kept = [s for s in lines if not (len(holders.get(key(s), ())) > 1 and min(holders[key(s)]) != r.doc_id)]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_mixture_budgets(spark):
    d = docs(spark)
    got = mixture.select_mixture(d, share=2000).collect()
    n = {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts())}
    assert all(r.n_tokens == n[r.doc_id] for r in got)
    assert sum(r.n_tokens for r in got) <= 2 * sum(n.values())
    assert max(collections.Counter((r.doc_id, r.epoch) for r in got).values()) == 1 and max(r.epoch for r in got) < mixture.MAX_EPOCHS
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 5), ("b", "x", "4", 1000)], "domain string, language string, source string, tokens long")
    b = {r.source: r.budget for r in mixture.leaf_budgets(leaves, 0, 1, {}, target=200).collect()}
    assert b == {"1": 10, "2": 85, "3": 5, "4": 100}  # siblings first: y and 1 are short, 2 takes it
    b = {r.source: r.budget for r in mixture.leaf_budgets(leaves, 0, 1, {}, target=600).collect()}
    assert b == {"1": 10, "2": 100, "3": 5, "4": 485}
    assert mixture.select_mixture(empty(spark)).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://X.NET/a", "https://example.net/en/1", "https://m.example.net/en/2?x#y", "http://example.net", "https://a.example.com/de/q", "http://w.org/fr/1", "http://notexample.com/de/1", "http://cheap-pills.com/x"] * 20
    df = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    want = [("", "", None), ("", "", None), ("", "", None), ("x.net", "/a", "net/"), ("example.net", "/en/1", "example.net/en/"), ("m.example.net", "/en/2", "example.net/en/"), ("example.net", "", None), ("a.example.com", "/de/q", "example.com/de/"), ("w.org", "/fr/1", "org/fr/"), ("notexample.com", "/de/1", None), ("cheap-pills.com", "/x", None)]
    for i, r in got.items():
        assert (r.host, r.path, r.rule) == want[i % len(want)]
        assert r.rule is None or r.verdict == url_filter.RULES[r.rule]
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_markov_scores(spark):
    rows = [("aab", "", 1), ("abb", "", 1), ("bba", "", 0)]
    n, c = url_filter.char_models(spark.createDataFrame(rows, "host string, path string, good int"))
    grams = [url_filter.ORDER * "^" + h + "$" for h, _, _ in rows] + ["^^^^zz$"]
    wanted = {s[i : i + 5] for s in grams for i in range(len(s) - 4)}
    got = {r.g: r.s for r in url_filter.gram_scores(spark.createDataFrame([(g,) for g in wanted], "g string"), n, c).collect()}

    def chance(g, good):
        p, seen = 1 / 256, [x for h, _, k in rows if k == good for s in ["^^^^" + h + "$"] for x in [s[i : i + 5] for i in range(len(s) - 4)]]
        for k in range(5):
            follow = collections.Counter(x[-1] for x in seen if x[4 - k : 4] == g[4 - k : 4])
            if follow:
                p = (follow[g[-1]] + len(follow) * p) / (sum(follow.values()) + len(follow))
        return p

    for g in wanted:
        assert got[g] == pytest.approx(np.log(chance(g, 1)) - np.log(chance(g, 0)))


def test_near_duplicates(spark):
    def shingles(t):
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in enumerate(texts())}
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            par[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs(spark)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, None)]
    par = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges[:-1]:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for e in edges[:-1] for x in e)


def test_language_id(spark):
    r = random.Random(2)
    syl = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ein", "ich", "ß"], "fr": ["eau", "é", "oi", "que"]}
    rows = [(i, " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(30)), k, "x") for i, k in enumerate(list(syl) * 60)]
    rows += [(1000, None, "en", "x"), (1001, "123 !!", None, "x"), (1002, "thering", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(df.where(language_id.fold() != 0))
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k, _ in rows[:180]) >= 178
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())
    nothing = language_id.fit(df.where("false"))
    assert {x.lang_pred for x in language_id.predict(df, nothing).collect()} == {"und"}


def test_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in sentencepiece_stream.encode_documents(docs(spark), P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts()):
        assert got[i] == sp.encode(t or "")
    assert all(r.restored for r in sentencepiece_stream.round_trip(docs(spark), P.path("piece_bpe_32k.model")).collect())


def test_streaming_viterbi():
    r = random.Random(4)
    scores = {"".join(p): -r.random() * 5 for n in (1, 2, 3) for p in itertools.product("ab", repeat=n)}

    def best(s):
        top = [(0.0, [])]
        for i in range(1, len(s) + 1):
            top.append(max((top[j][0] + scores[s[j:i]], top[j][1] + [s[j:i]]) for j in range(max(0, i - 3), i)))
        return top[-1][0]

    for _ in range(50):
        s = "".join(r.choice("ab") for _ in range(r.randint(1, 90)))
        st = sentencepiece_stream.Stream(sentencepiece_stream.Sums(scores), 3)
        got = st.feed(s) + st.finish()
        assert "".join(got) == s and sum(scores[p] for p in got) == pytest.approx(best(s))


def test_licenses(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    rows = [(1, "x " * 50 + "Released under the   MIT license.\nmore", 1), (2, None, 1), (3, "", 1), (4, "nothing of the kind " * 500, 1), (5, "intro " + apache.replace("obtain a copy", "get one copy") + " outro", 1), (5, "Licensed under CC BY-NC 4.0", 1)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, matches int")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append([(m.template, m.coverage) for m in r.matches])
    assert by[1] == [[("MIT-notice", 1.0)]] and by[2] == by[3] == by[4] == [[]]
    assert sorted(len(x) for x in by[5]) == [1, 1] and {x[0][0] for x in by[5]} == {"Apache-2.0", "CC-BY-NC-4.0-notice"}
    m = next(r.matches[0] for r in got if r.doc_id == 1)
    assert rows[0][1][m.start : m.end] == "Released under the   MIT license"
    assert hashlib.sha256(b"").hexdigest()  # spans are over characters of the given text


def test_sketches():
    """Sketches never refute a link, decide short sets exactly and prove only links."""
    r = random.Random(3)
    pool = [f"w{i}" for i in range(5000)]
    base = [[r.choice(pool) for _ in range(n)] for n in (8, 40, 200, 900, 2000)]
    docs = []
    for words in base:
        for changes in (0, 1, len(words) // 40, len(words) // 25, len(words) // 8):
            copy = list(words)
            for _ in range(changes):
                copy[r.randrange(len(copy))] = r.choice(pool)
            docs.append(" ".join(copy))
    sets = minhash_dedup.shingle_sets(docs)
    size = np.array([len(s) for s in sets])
    sketch = [(s[: minhash_dedup.SKETCH] >> np.uint64(32)).astype(np.uint32) for s in sets]
    for x in range(len(docs)):
        y = np.array([k for k in range(len(docs)) if k != x])
        proven, open_ = (set(k.tolist()) for k in minhash_dedup._compare(x, y, size, sketch, 75))
        for k in y.tolist():
            both = len(np.intersect1d(sets[x], sets[k]))
            link = 100 * both >= 75 * (len(sets[x]) + len(sets[k]) - both)
            assert not link or k in proven | open_
            assert link or k not in proven
            if max(size[x], size[k]) <= minhash_dedup.SKETCH:
                assert link == (k in proven | open_)


def test_tile_pairs_keep_components():
    """What a tile leaves joins the same vectors as all its links do."""
    import pandas as pd

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    start = [r.choice(words) for _ in range(120)]
    docs = []
    for _ in range(60):
        copy = list(start)
        for _ in range(r.randint(0, 8)):
            copy[r.randrange(len(copy))] = r.choice(words)
        docs.append(" ".join(copy))
    sets = minhash_dedup.shingle_sets(docs)
    sig = minhash_dedup.signatures(sets)
    n = len(docs)
    rows = [
        (k << 32, 0, 0, 2, i, i, sig[i], sum(1 << c for c in range(minhash_dedup.K)) - (1 << 64), len(sets[i]), (sets[i][: minhash_dedup.SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
        for k in range(minhash_dedup.K)
        for i in range(n)
    ]
    pdf = pd.DataFrame(rows, columns=["token", "i", "j", "side", "rep", "c", "sig", "pre", "size", "sketch"])
    got = minhash_dedup._tile_pairs(75)(pdf)

    def groups(pairs):
        label = list(range(n))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        return {frozenset(i for i in range(n) if label[i] == v) for v in label}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    kept = [(a, b) for a, b in zip(got["a"], got["b"], strict=True) if linked(a, b)]
    every = [(a, b) for a, b in itertools.combinations(range(n), 2) if linked(a, b) and (sig[a] == sig[b]).sum() >= minhash_dedup.T]
    assert groups(kept) == groups(every)
    assert len(got) < max(len(every), n * 3)


def test_parts_at_marks():
    """Marks, runs of spaces and unknown characters give the library's ids."""
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=file), sentencepiece_stream.codec(file), random.Random(7)
    for _ in range(3000):
        t = "".join(r.choice("aeinrst ,._-0123éß\n\t中☃{}();'  ▁A”»“") for _ in range(r.randint(0, 40)))
        assert np.frombuffer(mine.encode([t])[0], mine.kind).tolist() == sp.encode(t.replace("▁", " "))


@pytest.mark.parametrize(
    "line, want",
    [
        ("Released under the BSD License", ["BSD-notice"]),
        ("Licensed under the EPL License", []),
        ("Released under the Zope Public License", []),
        ("Licensed under the Modified MIT License", []),
        ("Licensed under the MIT-0 License", []),
        ("Licensed under the terms of the MIT License", ["MIT-notice-2"]),
        ("Released under MIT License", ["MIT-notice"]),
        ("Licensed under CC BY-ND 4.0", []),
        ("Licensed under CC BY-NC-SA 4.0", []),
        ("Licensed under CC BY 3.0", []),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0-notice"]),
        ("Licensed under the Apache License, Version 1.1", []),
        ("Licensed under the Apache License 2.0", ["Apache-2.0-notice"]),
        ("licensed under the GNU Affero General Public License, version 2", []),
        ("licensed under the GNU Lesser General Public License, version 3", ["LGPL-notice"]),
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", []),
        ("This is free and unencumbered software released in the public domain.", ["Unlicense"]),
    ],
)
def test_notices_of_other_licenses(line, want):
    index = license_scan.Index(license_scan.TEMPLATES)
    for text in (line, f"Some words in front.\n{line}. And words behind it"):
        hits = index.hits([license_scan.normal(text)])
        assert [f["template"] for f in license_scan.scan(index, text, hits.get(0, []), license_scan.COVERAGE)] == want, text


def test_long_parts_stream():
    """Unbroken texts give the library's ids, and the window stays short where paths meet."""
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    sp, mine, r = sentencepiece.SentencePieceProcessor(model_file=file), sentencepiece_stream.codec(file), random.Random(9)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "a"):
        t = "".join(r.choice(letters) for _ in range(5000))
        assert np.frombuffer(mine.encode([t])[0], mine.kind).tolist() == sp.encode(t)
        st = sentencepiece_stream.Stream(mine.rule, mine.max_piece)
        st.feed(t)
        assert st.most < 20 * mine.max_piece, letters


def model_bytes(kind, pieces):
    """A SentencePiece model written by hand: pieces as (text, score, type); no training."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def held(n, data):
        return varint(n << 3 | 2) + varint(len(data)) + data

    def number(n, x):
        return varint(n << 3) + varint(x)

    out = b"".join(held(1, held(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", x) + number(3, k)) for t, x, k in pieces)
    trainer = number(3, kind) + number(4, len(pieces)) + number(35, int(any(k == 6 for *_, k in pieces))) + number(40, 0) + number(41, 1) + number(42, 2)
    return out + held(2, trainer) + held(3, held(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_model(tmp_path, with_bytes):
    """Sums of scores (multiples of 1/64, so no rounding) against the library, with unknown characters, marks and long parts."""
    import sentencepiece

    r = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    names = ["▁", *"abcde.,", *("".join(p) for n in (2, 3) for p in itertools.product("abc", repeat=n)), "▁a", "▁ab", "▁cab", "▁▁", "d.", "de", "abcab"]
    pieces += [(p, -r.randint(64, 640) / 64, 1) for p in names]
    (tmp_path / "m.model").write_bytes(model_bytes(1, pieces))
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), sentencepiece_stream.Codec(str(tmp_path / "m.model"))
    assert isinstance(mine.rule, sentencepiece_stream.Sums)
    for n in [*[r.randint(0, 30) for _ in range(1500)], 6000]:
        t = "".join(r.choice("aaabbbcccde., zé☃") for _ in range(n)) if n < 6000 else "".join(r.choice("abc") for _ in range(n))
        assert np.frombuffer(mine.encode([t])[0], mine.kind).tolist() == sp.encode(t), t
        if with_bytes:
            assert mine.decode(mine.encode([t])[0]) == t


def test_models_of_other_kinds_are_refused(tmp_path):
    for kind in (3, 4):
        (tmp_path / "m.model").write_bytes(model_bytes(kind, [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁a", -1.0, 1)]))
        with pytest.raises(ValueError):
            sentencepiece_stream.Codec(str(tmp_path / "m.model"))


def test_sentencepiece_rows(spark):
    """Empty table, clashing columns, null and repeated ids, a text with one part of 9,000 characters."""
    file = P.path("piece_bpe_32k.model")
    assert sentencepiece_stream.round_trip(empty(spark), file).count() == 0
    rows = [(1, "b" * 9000, "x", 1), (None, None, "x", 2), (1, "", None, 3), (1, "again", "y", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, restored string, ids int")
    got = sentencepiece_stream.round_trip(d, file).collect()
    assert len(got) == 4 and all(x.restored for x in got)
    back = sentencepiece_stream.decode_documents(sentencepiece_stream.encode_documents(d, file), file).collect()
    assert sorted(x.text for x in back) == sorted(t or "" for _, t, *_ in rows)
