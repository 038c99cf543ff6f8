"""The near-duplicate stage against all pairs of a small table: cut, appended, repeated and chained copies."""

import numpy as np
import pytest

import corpus_pipeline
from lattiq.llm import simhash

rng = np.random.default_rng(4)
WORDS = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)]


def drawn(n):
    return [str(x) for x in rng.choice(WORDS, n)]


def expected(rows):
    """The least id of each component of the pairs with a Jaccard of 0.8 or more."""
    sets = {i: simhash.shingles_of(t, 5) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in ids})


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.deduplicated(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def numbered(texts):
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_cut_and_appended_copies_are_found(spark):
    texts = []
    for n in (60, 120, 200, 500, 900):
        for _ in range(6):
            a = drawn(n)
            texts += [a, [*a, *drawn(int(0.2 * n))], a[: int(0.83 * n)], a[: int(0.7 * n)]]
    rows = numbered(texts)
    assert kept(spark, rows) == expected(rows)


def test_lines_repeated_a_different_number_of_times(spark):
    texts = []
    for _ in range(5):
        lines = [drawn(8) for _ in range(3)]
        a = sum(lines, [])
        texts += [a * 4, a * 2, a * 9, drawn(40)]
    rows = numbered(texts)
    assert kept(spark, rows) == expected(rows) == sorted(i for i in range(len(rows)) if i % 4 in (0, 3))


def families(count, size, edits, n=150):
    texts = []
    for _ in range(count):
        a = drawn(n)
        for _ in range(size):
            copy = [*a]
            for at in rng.choice(n, edits, replace=False):
                copy[at] = drawn(1)[0]
            texts.append(copy)
    return texts


@pytest.mark.parametrize(("size", "edits"), [(6, 2), (20, 2), (20, 3)])
def test_failed_pairs_do_not_split_families(spark, size, edits):
    rows = numbered(families(20, size, edits))
    assert kept(spark, rows) == expected(rows)


def test_chains_and_dealt_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    rows = numbered([*(drawn(0) or a[k : k + 150] for a in [drawn(600)] for k in range(0, 450, 12)), *families(2, 60, 3)])
    assert kept(spark, rows) == expected(rows)


def test_pipeline_stage_equals_brute_force(spark):
    a, line = drawn(200), drawn(8)
    copies = [a, a[:170], [*a, *drawn(40)], line * 4, line * 9, *(drawn(0) or c for c in families(3, 6, 2)), *([*a[k:], *a[:k]] for k in (10, 40, 70))]
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    first = max(i for i, _ in docs) + 1
    rows = [*docs, *((first + i, t) for i, t in numbered(copies))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r.doc_id for r in stage(spark, table, "/root/testdata/sf0.001").collect()) == expected(rows)


def test_only_texts_that_may_be_compared_are_shuffled(spark):
    rows = spark.range(-5, 20_000).selectExpr("id as d").union(spark.sql("select cast(null as bigint)"))
    ids = spark.range(0, 20_000, 50).selectExpr("id as doc_id").union(spark.sql("select cast(null as bigint)"))
    found = [r.d for r in simhash.possibly_in(rows, "d", ids).collect()]
    assert {r.doc_id for r in ids.collect()} <= set(found) and len(found) < 450  # 401 ids
    rest = [r.d for r in simhash.possibly_in(rows, "d", ids, how="left_anti").collect()]
    assert len(rest) + len(found) == rows.count() and not set(rest) & set(found)
    crowded = simhash.possibly_in(rows, "d", ids, bits=64).collect()
    assert {r.doc_id for r in ids.collect()} <= {r.d for r in crowded}


def test_a_step_of_pairs_is_small():
    key, part = np.zeros(3000, np.int64), np.arange(3000)
    steps = [len(i) for i, _ in simhash.across(key, part)]
    assert sum(steps) == 3000 * 2999 // 2 and max(steps) * 100 <= 32 << 20  # about 100 bytes a pair
