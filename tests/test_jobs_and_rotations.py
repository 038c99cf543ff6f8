"""Jobs that go on where a run ended, bundles in half precision, and quaternions, against numpy."""

import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.functions import halves, rotations
from lattiq.sources import sinks


class Killed(Exception):
    pass


def test_a_killed_run_goes_on_with_the_rest(spark, tmp_path):
    path, seen = f"file://{tmp_path}/jobs", tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([(i % 12, i) for i in range(60)], "job bigint, v bigint")
    folder = str(seen)

    def work(key, pdf):
        import os

        os.makedirs(f"{folder}/{key[0]}-{uuid.uuid4().hex}")
        if key[0] == 5:
            raise ValueError("no")
        return pd.DataFrame({"job": key[0], "total": [pdf["v"].sum()] * (0 if key[0] == 7 else 2)})

    def runs():
        out = {}
        for p in seen.iterdir():
            out[int(p.name.split("-")[0])] = out.get(int(p.name.split("-")[0]), 0) + 1
        return out

    done = []

    def kill_in_the_third(batch):
        done.append(batch)
        if len(done) == 3:
            raise Killed  # its rows are written, its lines are not

    with pytest.raises(Killed):
        sinks.resumed(rows, ["job"], work, "job bigint, total bigint", path, 6, after_data=kill_in_the_third)
    first = runs()
    assert 0 < len(first) < 12 and set(first.values()) == {1}
    batch = {r.job: r.b for r in rows.select("job", F.pmod(F.xxhash64("job"), F.lit(6)).alias("b")).distinct().collect()}
    found, state = sinks.resumed(rows, ["job"], work, "job bigint, total bigint", path, 6)
    lost = {j for j in batch if batch[j] == done[2]}
    again = {j: n for j, n in runs().items() if n > 1}
    assert set(again) - {5} == lost - {5} and set(runs()) == set(range(12))
    got = {r.job: (r.status, r.n_rows, r.error) for r in state.collect()}
    assert got[5] == ("failed", 0, "ValueError: no") and got[7] == ("done", 0, None) and all(got[j] == ("done", 2, None) for j in set(range(12)) - {5, 7})
    want = {j: sum(i for i in range(60) if i % 12 == j) for j in set(range(12)) - {5, 7}}
    assert sorted((r.job, r.total) for r in found.collect()) == sorted((j, t) for j, t in want.items() for _ in (0, 1))
    before = runs()
    found, state = sinks.resumed(rows, ["job"], work, "job bigint, total bigint", path, 6)
    assert {j for j, n in runs().items() if n > before[j]} == {5}  # only what failed is tried again
    assert found.count() == 20 and state.count() == 12


def test_many_small_jobs_share_tasks_and_a_job_spans_batches(spark, tmp_path):
    jobs = 20_000
    rows = spark.range(jobs).selectExpr("id % 2 as kind", "id as job", "id as v").unionByName(spark.range(5000).selectExpr("0L as kind", "-1L as job", "id as v"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")

    def work(key, pdf):
        if key[1] == 3:
            raise ValueError("no")
        assert (pdf["job"] == key[1]).all() and (pdf["kind"] == key[0]).all()
        return pd.DataFrame({"total": [pdf["v"].sum()]})

    try:
        begun = time.time()
        found, state = sinks.resumed(rows, ["kind", "job"], work, "total bigint", f"file://{tmp_path}/many", 2)
        got = {(r.kind, r.job): r.total for r in found.collect()}
        assert time.time() - begun < 60  # a group of its own for each job took longer
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(i % 2, i): i for i in range(jobs) if i != 3} | {(0, -1): sum(range(5000))}
    assert [tuple(r) for r in state.filter("status = 'failed'").select("kind", "job", "error").collect()] == [(1, 3, "ValueError: no")] and state.count() == jobs + 1


def test_jobs_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([], "job bigint, v bigint")
    found, state = sinks.resumed(rows, ["job"], lambda k, p: p, "job bigint, v bigint", f"file://{tmp_path}/none")
    assert found.count() == 0 and state.count() == 0


def test_halves_are_those_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(3000), rng.standard_normal(2000) * 1e-5, rng.standard_normal(2000) * 3e4, 2.0 ** np.arange(-26, 17), 2.0 ** np.arange(-26, 17) * (1 + 2.0**-11), -(2.0 ** np.arange(-14, 16)), np.arange(0, 40) * 2.0**-25, [0.0, 65504, 65519.99, 65520, 1e300, np.inf, -np.inf, np.nan, 5e-324]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "i bigint, x double")
    rows = sorted(tuple(r) for r in df.select("i", halves.half(F.col("x")).alias("h")).withColumn("w", halves.whole(F.col("h"))).collect())
    assert rows[0][1:] == (None, None)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16)
    got = np.array([r[1] for r in rows[1:]], np.int16)
    assert (got.view(np.float16)[~np.isnan(x)] == want[~np.isnan(x)]).all() and np.isnan(got.view(np.float16)[np.isnan(x)]).all()
    back = np.array([r[2] for r in rows[1:]])
    assert np.array_equal(back, want.astype(float), equal_nan=True)


def test_bundles_keep_their_parameters(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5, 0.1, None), (1, -2.25, 0.2, 3.0)], "part bigint, v double, s double, t double")
    path = f"file://{tmp_path}/bundle"
    sinks.written_bundle(df, path, {"shape": [3, 4, 5], "species": "o2"}, ["v", "t"], ["s"], ["part"])
    back, parameters = sinks.read_bundle(spark, path)
    assert parameters == {"shape": [3, 4, 5], "species": "o2"}
    assert sorted((r.part, r.v, r.t) for r in back.collect()) == [(0, 1.5, None), (1, -2.25, 3.0)] and dict(back.dtypes)["s"] == "float"


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_quaternions_turn_as_matrices_do(spark):
    rng = np.random.default_rng(1)
    e, v = rng.uniform(-170, 170, (40, 3)), rng.standard_normal((40, 3))
    e[:, 1] /= 2
    df = spark.createDataFrame([(i, *map(float, a), b.tolist()) for i, (a, b) in enumerate(zip(e, v))], "i bigint, a double, b double, c double, v array<double>")
    q = rotations.of_angles([F.col(c) for c in "abc"])
    rows = df.select("i", q.alias("q"), "v").select("i", "q", rotations.turned(F.col("q"), F.col("v")).alias("t"), rotations.angles(F.col("q")).alias("e"), rotations.multiplied(F.col("q"), rotations.conjugate(F.col("q"))).alias("one"), rotations.about(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(np.pi / 2)).alias("z")).orderBy("i").collect()
    for r, a, b in zip(rows, np.radians(e), v):
        (cx, cy, cz), (sx, sy, sz) = np.cos(a), np.sin(a)
        m = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
        assert np.allclose(matrix(r.q), m) and np.allclose(r.t, m @ b) and np.allclose(r.e, np.degrees(a)) and np.allclose(r.one, [1, 0, 0, 0])
    assert np.allclose(matrix(rows[0].z) @ [1, 0, 0], [0, 1, 0])


def test_blends_are_even_and_take_the_shorter_arc(spark):
    keys = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0, 0.0]), (1, 20, [-float(np.cos(0.5)), -float(np.sin(0.5)), 0.0, 0.0]), (1, 30, [float(np.cos(0.5)), float(np.sin(0.5)), 0.0, 1e-9]), (2, 5, [0.0, 1.0, 0.0, 0.0])], "track bigint, i bigint, q array<double>")
    frames = spark.createDataFrame([(1, f, f / 4) for f in range(12)] + [(2, 0, 0.0), (2, 1, 0.7)], "track bigint, frame bigint, keyframe double")
    got = {(r.track, r.frame): np.array(r.q) for r in rotations.oriented(frames, keys).collect()}
    assert len(got) == 14
    for f in range(5):
        assert np.allclose(np.abs(got[1, f] @ [np.cos(f / 8), np.sin(f / 8), 0, 0]), 1)
    assert all(np.isclose(np.linalg.norm(q), 1) for q in got.values()) and np.allclose(got[2, 1], [0, 1, 0, 0])


def test_locked_tracks_and_tracks_without_a_look(spark):
    rows = [(1, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 4.0], [0.0, 1.0, 1.0]), (1, 1, [1.0, 2.0, 3.0], [9.0, 9.0, 9.0], [1.0, 0.0, 0.0]), (2, 0, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0], [0.0, 1.0, 0.0]), (2, 1, [2.0, 2.0, 2.0], [5.0, 5.0, 5.0], [1.0, 0.0, 0.0]), (3, 0, [0.0] * 3, [0.0, 2.0, 0.0], [0.0, 3.0, 0.0])]
    df = spark.createDataFrame(rows, "k bigint, i bigint, place array<double>, focus array<double>, up array<double>")
    got = {(r.k, r.i): (r.focus, r.up) for r in rotations.locked(df, "k", "i").collect()}
    assert got[1, 0] == ([0, 0, 4], [0, 1, 0]) and got[1, 1] == ([1, 2, 7], [0, 1, 0])
    assert got[2, 1] == ([5, 5, 5], [1, 0, 0]) and got[3, 0] == ([0, 2, 0], [0, 1, 0])
