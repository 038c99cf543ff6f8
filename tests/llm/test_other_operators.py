"""Neighbours, URLs, conversations and the pipeline."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lattiq.llm import bpe, chat, decontaminate, neighbours, pii, quality, queries, url_filter
from tests.llm.test_near_copies import expected
from tests.parity import difference

SF = "/root/testdata/sf0.001"


def test_neighbours_reach_nine_tenths_and_rank_exactly(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.search(spark, table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found = got[ids[i]]
        assert sorted(found) == list(range(1, 21))
        order = [(-found[k][1], found[k][0]) for k in range(1, 21)]
        assert order == sorted(order) and all(abs(found[k][1] - s[ids == found[k][0]][0]) < 1e-12 for k in found)
        recall.append(len({v for v, _ in found.values()} & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9


def recall_of(got, rows, k=20):
    """The share of true neighbours among those found (query_id: set of ids), rows: (vec_id, vector)."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        out.append(len(got[int(ids[i])] & set(ids[np.lexsort((ids, -s))[:k]].tolist())) / k)
    return float(np.mean(out))


def found_by(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def test_neighbours_recall_on_more_vectors_and_exact_mode(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall_of(found_by(neighbours.search(spark, table)), rows) >= 0.9
    few = table.filter("vec_id < 600")
    some = [r for r in rows if r[0] < 600]
    assert recall_of(found_by(neighbours.search(spark, few, part=1.0)), some) == 1.0


def test_neighbours_are_k_on_tables_of_any_size(spark):
    rng = np.random.default_rng(8)
    for n in range(1, 65):  # what search() probes, for every query, without Spark
        x = rng.standard_normal((n, 6))
        forest = neighbours.Forest(np.unique(x, axis=0), 2, max(8, int(n * min(neighbours.LEAF, n / 64) / n)))
        leaves = forest.leaves(x)
        rows = np.bincount(leaves.ravel(), minlength=len(forest.left))
        for i in range(n):
            seen = np.isin(leaves, forest.probe(x[i], 0.6, rows, 21)).any(1)
            assert seen.sum() - seen[i] >= min(20, n - 1)
    for n in (2, 18, 22, 40):
        df = spark.createDataFrame([(20 * i, rng.standard_normal(6).tolist()) for i in range(n)] + [(20, rng.standard_normal(6).tolist())] * 3, "vec_id bigint, embedding array<double>")
        got = neighbours.search(spark, df).groupBy("query_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {min(20, n - 1)}


def test_neighbours_need_few_leaves_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] * 4 + rng.standard_normal(16) * 0.3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert recall_of(found_by(neighbours.search(spark, df, trees=4, part=0.15)), rows) >= 0.9


def test_neighbours_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [0.0, 0.0]), (80, None), (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [float("inf"), 1.0]), (160, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, leaf string, rank int")
    got = {}
    for r in neighbours.search(spark, df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40]
    assert sorted(got[0]) == [(k, k, 1.0) for k in range(1, 21)]
    assert sorted(got[20]) == [(k + 1, k, 1.0) for k in range(20)]
    few = neighbours.search(spark, df.filter("vec_id in (20, 21, 22)")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(20, 1, 21), (20, 2, 22)]
    assert neighbours.search(spark, df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Www.Example.COM/en/x?y#z", "https://a.example.com/en/", "http://x.com", "http://x.com/", "ftp://b.net/es/1", "http://net/fr/#a", "http://q.org?x=/en/", "//a://b/c", "http://ünï.ORG/Ä", "http://a.com://b/", "http://evilexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, urls[3], "h", "r")], "page_id bigint, url string, host string, rule string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "page_id bigint, bad int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels, queries.RULES).collect())
    want = [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (3, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (4, "a.example.com", "/en/", "example.com/en/", "block"), (5, "x.com", "", None, "allow"), (6, "x.com", "/", "com/", "allow"), (7, "b.net", "/es/1", "net/es/", "block"), (8, "net", "/fr/", "net/fr/", "block"),
        (9, "q.org", "", None, "allow"), (10, "a:", "//b/c", None, "allow"), (11, "ünï.org", "/Ä", None, "allow"), (12, "a.com:", "//b/", None, "allow"), (13, "evilexample.com", "/en/", "com/", "allow"),
    ]
    assert [g for g in got if g[0] != 10] == [w for w in want if w[0] != 10]
    assert url_filter.judge(pages.limit(0), labels, queries.RULES).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.example.com": ("y.example.com", "example.com"), "example.com": ("example.com", "com"), "a.b.org:80": ("b.org", "org"), "10.0.0.1:8080": ("10.0.0.1", ""), "localhost": ("localhost", "localhost"), "me@a.b.net": ("b.net", "net"), "": ("", ""), "co.uk": ("co.uk", "uk"), "[::1]": ("[::1]", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", url_filter.domain_of(df.host).alias("d"), url_filter.suffix_of(df.host).alias("s")).collect()}
    assert got == hosts


def test_reputation_shrinks_and_blocks(spark):
    hosts = spark.createDataFrame([("bad.example.org", 200, 190), ("sub.bad.example.org", 2, 0), ("fine.example.org", 300, 3), ("new.example.net", 1, 1)], "host string, n bigint, bad bigint")
    r = {x.host: x for x in url_filter.shrink(hosts).collect()}
    assert r["bad.example.org"].lower > 0.8 and r["fine.example.org"].lower < 0.05
    assert r["sub.bad.example.org"].posterior > 0.2  # drawn towards its domain
    assert r["new.example.net"].posterior < 1 and r["new.example.net"].lower < 0.6
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'fine'}.example.org/{i}") for i in range(400)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "page_id bigint, bad int")
    got = {(x.host, x.verdict) for x in url_filter.judge(pages, labels, []).collect()}
    assert got == {("bad.example.org", "block"), ("fine.example.org", "allow")}


def fold_by_hand(events):
    out = []
    for _, _, kind, number, role, text in events:
        if kind == "message":
            out.append([role or "", text or "", True])
            continue
        k = (number or len(out)) - 1
        if not 0 <= k < len(out):
            continue
        if kind == "delta":
            out[k][1] += text or ""
        elif kind == "edit":
            out[k][1] = text or ""
        else:
            out[k][1] = ""
            for later in out[k + 1 :]:
                later[2] = False
    return [(r, t) for r, t, live in out if live]


def test_events_fold_render_and_read_back(spark):
    e = [
        (1, 0, "message", None, "user", "hi <|im_start|> \\ </s>"), (1, 1, "message", None, "assistant", ""), (1, 2, "delta", None, None, "par"), (1, 3, "delta", None, None, "tial"), (1, 4, "regenerate", 2, None, None),
        (1, 5, "delta", 2, None, "whole <\\|im_end|>"), (1, 6, "message", None, "user", "more"), (1, 7, "edit", 1, None, "hello"), (1, 8, "message", None, "assistant", "x"), (1, 9, "regenerate", 2, None, None), (1, 10, "delta", 2, None, "again"), (1, 11, "message", None, "user", "bye"),
        (2, 0, "message", None, "us\ner <s>", None), (2, 0, "delta", 9, None, "lost"), (3, 1, "delta", None, None, "lost"), (None, 1, "message", None, None, "[INST][\\INST]"), (2, 5, "unknown", None, None, "x"),
    ]
    df = spark.createDataFrame([(*x, "c") for x in e], "conv_id bigint, seq bigint, kind string, message bigint, role string, text string, place string")
    final = chat.fold(df)
    by = {}
    for r in final.orderBy("message").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: fold_by_hand([x for x in e if x[0] == c]) for c in (1, 2, None)}
    assert by == {c: v for c, v in want.items() if v}
    shown = chat.render(final)
    for r in shown.collect():
        assert r.formatted.count(chat.OPEN) == len(by[r.conv_id]) == r.formatted.count(chat.CLOSE)
        assert not any(m in r.formatted for m in ("</s>", "<s>", "[INST]"))
    back = {}
    for r in chat.read_back(shown).orderBy("turn").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.masked == (r.text if r.role == "assistant" else None)
    assert back == by
    assert chat.digests(chat.render(chat.fold(df.limit(0)))).count() == 0


def test_url_query_equals_its_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert difference(queries.op8_url_filter(spark, sf), queries.ORACLE_SQL["op8_url_filter"], sf) is None


def test_chat_query_equals_its_sql(spark):
    assert difference(queries.op9_chat_format(spark, SF), queries.ORACLE_SQL["op9_chat_format"], SF) is None
    r = queries.op9_chat_format(spark, SF).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_plan_is_native(spark):
    plan = queries.op9_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, columns, kept = docs, docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == columns
            at.write.mode("overwrite").parquet(str(tmp_path / name))
            at = spark.read.parquet(str(tmp_path / name))
            kept.append(at.count())
    assert kept == sorted(kept, reverse=True) and kept[4] == kept[3] and at.count() == kept[4] > 0.6 * kept[0]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in at.collect())
    leaked = {r.doc_id for r in queries.op1_benchmark_decontamination(spark, SF).collect()}
    assert not leaked & {r.doc_id for r in at.collect()}


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() on short documents against all pairs, a tiling of every document by every item, and the library's ids."""
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500")
    docs.write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(spark, docs, labels).filter("predicted = 1").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    left = expected(sorted(texts.items()))
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaked(text):
        w = decontaminate.words(text)
        number = {x: n for n, x in enumerate({*w, *(x for i in items for x in i)})}
        ids = np.array([number[x] for x in w], np.int64)
        return any(sum(t[2] for t in decontaminate.tiles(ids, np.array([number[x] for x in i], np.int64), min(5, len(i)))) >= 0.5 * len(i) for i in items if i)

    ranks = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k in left:
        if not leaked(texts[k]):
            text = pii.masked(texts[k], pii.find(pii.trained(), [texts[k]])[1][0])
            want[k] = hashlib.sha256(np.array(encoding.encode_ordinary(text), "<u4").tobytes()).hexdigest()
    assert 20 < len(want) < len(texts)
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_quality_on_the_fold_that_it_never_saw(spark):
    """Accuracy over the held-out labels of the tables, and the classes it is never to mix."""
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    truth = [(scores[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").dropna().collect() if r.doc_id in scores]
    held = [(s.predicted, q) for s, q in truth if s.held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) >= 0.95


def test_an_id_that_many_rows_share_is_learned_from_once(spark):
    docs = spark.range(100_000).selectExpr("1L as doc_id", "concat('row ', cast(id % 7 as string)) as text").unionByName(spark.createDataFrame([(k, f"a text of its own {k}") for k in range(2, 40)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id bigint, quality int")
    assert quality.classify(spark, docs, labels).count() == 100_038


def test_driver_views_hold_for_the_url_rules(spark):
    """Hosts and paths of the pages as DuckDB's own functions see them."""
    c = duckdb.connect()
    want = {r[0]: r[1:] for r in c.execute(rf"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1), regexp_extract(url, '://[^/?#]*([^?#]*)', 1) FROM read_parquet('{SF}/pages.parquet')").fetchall()}
    assert all(want[r.page_id] == (r.host, r.path) for r in queries.op8_url_filter(spark, SF).collect())


def test_suffix_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("// rules\ncom\nCO.uk  // said\n\nuk\n*.ck\n!www.ck\n*.city.jp\n!city.city.jp\njp\ngithub.io\ncom\n")
    rules = url_filter.read_suffixes(spark, f"file://{tmp_path}/rules.txt")
    assert rules.count() == 9
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.uk": ("b.uk", "uk"), "co.uk": ("co.uk", "uk"), "x.y.foo.ck": ("y.foo.ck", "foo.ck"), "a.www.ck": ("www.ck", "ck"), "www.ck": ("www.ck", "ck"), "foo.ck": ("foo.ck", "ck"),
        "p.q.r.city.jp": ("q.r.city.jp", "r.city.jp"), "p.city.city.jp": ("city.city.jp", "city.jp"), "me.github.io": ("me.github.io", "github.io"), "u@a.nowhere.zz:80": ("nowhere.zz", "zz"), "single": ("single", "single"),
        "10.0.0.1": ("10.0.0.1", ""), "": ("", ""),
    }
    df = spark.createDataFrame([(h, 2, 1) for h in want], "host string, n bigint, bad bigint")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_domains(df, rules).collect()}
    assert got == want
    few, url_filter.FEW_RULES = url_filter.FEW_RULES, 0
    try:
        assert {r.host: (r.domain, r.suffix) for r in url_filter.with_domains(df, rules).collect()} == want
    finally:
        url_filter.FEW_RULES = few
    assert url_filter.shrink(df, suffixes=rules).count() == len(want) and url_filter.shrink(df.limit(0), suffixes=rules).count() == 0
    named = url_filter.SUFFIXES
    table = spark.createDataFrame([(s, 0) for s in named], "tail string, kind int")
    both = [sorted((r.host, round(r.lower, 9)) for r in url_filter.shrink(df, suffixes=x).collect()) for x in (named, table)]
    assert both[0] == both[1]
