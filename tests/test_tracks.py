"""Track kernels over many tracks at once against one track at a time, in plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.operators import paths, timelines
from lattiq.plans import builds


def _tracks(seed=0, many=60):
    rng = np.random.default_rng(seed)
    return {k: np.cumsum(rng.standard_normal((int(rng.integers(1, 40)), 3)) * (k % 4), axis=0) for k in range(many)}


def _rows(spark, tracks, more=()):
    rows = [(k, i, *map(float, p)) for k, t in tracks.items() for i, p in enumerate(t)]
    return spark.createDataFrame(rows, "k bigint, i bigint, z double, y double, x double").repartition(7)


def _line_kept(p, eps):
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        s = d @ d
        t = np.clip((p[a + 1 : b] - p[a]) @ d / s, 0, 1) if s > 0 else np.zeros(b - a - 1)
        off = np.linalg.norm(p[a + 1 : b] - p[a] - t[:, None] * d, axis=1)
        j = int(off.argmax())
        if off[j] > eps:
            keep.add(a + 1 + j)
            todo += [(a, a + 1 + j), (a + 1 + j, b)]
    return sorted(keep)


def test_simplified_tracks(spark):
    tracks = _tracks()
    got = {}
    for r in paths.simplified(_rows(spark, tracks), "k", "i", ["z", "y", "x"], 2.5).collect():
        got.setdefault(r.k, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: _line_kept(t, 2.5) for k, t in tracks.items()}


def test_splined_tracks(spark):
    tracks = _tracks(1)
    got = paths.splined(_rows(spark, tracks), "k", "i", ["z", "y", "x"], 4).toPandas()
    for k, t in tracks.items():
        mine = got[got.k == k].sort_values("i")
        assert mine.i.tolist() == list(range(4 * (len(t) - 1) + 1))
        assert np.allclose(mine[["z", "y", "x"]].to_numpy(), paths.kochanek(t, 4)[0]) and np.allclose(mine[["z", "y", "x"]].to_numpy()[::4], t)


def _directions(p, focus, reach=8, weight=0.12, still=0.005, up=np.array([0.0, 1.0, 0.0])):
    raw = np.array([p[min(len(p) - 1, i + reach)] - p[max(0, i - reach)] for i in range(len(p))])
    way = np.linalg.norm(raw, axis=1)
    least = still * (np.median(way[way > 0]) if (way > 0).any() else 1.0)
    held, out = None, []
    for i in range(len(p)):
        if way[i] > least and np.linalg.norm(np.cross(raw[i] / way[i], up)) > 0.05:
            new = raw[i] / way[i]
            if held is not None:
                new = (1 - weight) * held + weight * new
                size = np.linalg.norm(new)
                new = new / size if size > 1e-9 else held
            held = new
        if held is None:
            d = focus[i] - p[i]
            held = d / np.linalg.norm(d) if np.linalg.norm(d) > 1e-9 else np.array([1.0, 0.0, 0.0])
        out.append(held)
    return np.array(out)


def test_travel_directions(spark):
    tracks = _tracks(2)
    tracks[100] = np.zeros((5, 3))  # never moves
    tracks[101] = np.column_stack([np.zeros(30), np.arange(30.0), np.where(np.arange(30) > 20, np.arange(30) - 20.0, 0)])  # along up at first
    df = _rows(spark, tracks).withColumns({"fz": F.col("z") * 0 + 3, "fy": F.col("i") * 1.0, "fx": F.col("x") * 0 - 1})
    got = paths.travel_directions(df, "k", "i", ["z", "y", "x"], focus=["fz", "fy", "fx"]).toPandas()
    plain = paths.travel_directions(df, "k", "i", ["z", "y", "x"]).toPandas()
    for k, t in tracks.items():
        focus = np.column_stack([np.full(len(t), 3.0), np.arange(len(t)), np.full(len(t), -1.0)])
        for found, aim in ((got, focus), (plain, t)):
            assert np.allclose(found[found.k == k].sort_values("i")[["dz", "dy", "dx"]].to_numpy(), _directions(t, aim)), k


def test_tracks_longer_than_a_batch_stay_whole(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        lengths = {k: (k * 13) % 70 + 1 for k in range(40)}
        df = spark.createDataFrame([(k, i) for k, n in lengths.items() for i in range(n)], "k bigint, i bigint").repartition(5)

        def count(pdf, begins):
            n = paths.lengths(begins, len(pdf))
            assert all((pdf["i"].to_numpy()[b : b + m] == np.arange(m)).all() for b, m in zip(begins, n))
            return pd.DataFrame({"k": pdf["k"].to_numpy()[begins], "n": n})

        assert {r.k: r.n for r in paths.by_track(df, "k", ["i"], count, "k bigint, n bigint").collect()} == lengths
        assert paths.by_track(df.limit(0), "k", ["i"], count, "k bigint, n bigint").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("ends", ["natural", "not-a-knot"])
def test_cubic_splines_join_smoothly(ends):
    rng = np.random.default_rng(3)
    knots = np.cumsum(rng.random(9) + 0.2)
    values = rng.standard_normal((9, 2))
    assert np.allclose(paths.cubic(knots, values, knots, ends), values)
    f = lambda x: paths.cubic(knots, values, np.atleast_1d(x), ends)[0]
    h = 1e-4
    for x in knots[1:-1]:
        left, right = (f(x) - 2 * f(x - h) + f(x - 2 * h)) / h**2, (f(x + 2 * h) - 2 * f(x + h) + f(x)) / h**2
        assert np.allclose((f(x) - f(x - h)) / h, (f(x + h) - f(x)) / h, atol=1e-2) and np.allclose(left, right, atol=0.05)
    second = (f(knots[0] + 2 * h) - 2 * f(knots[0] + h) + f(knots[0])) / h**2
    third = lambda x: (f(x + 3 * h * 10) - 3 * f(x + 2 * h * 10) + 3 * f(x + h * 10) - f(x)) / (h * 10) ** 3
    if ends == "natural":
        assert np.abs(second).max() < 0.05
    else:
        assert np.allclose(third(knots[0] + 0.01), third(knots[1] + 0.01), atol=0.2)


def test_rings_stand_every_spacing_on_the_moved_path(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 3.0, 0.0), (0, 2, 3.0, 3.0), (1, 0, 5.0, 5.0), (2, 0, 0.0, 0.0), (2, 1, 2.0, 0.0)], "k bigint, i bigint, y double, x double")
    got = sorted(tuple(r) for r in timelines.rings(df, ["k"], ["i"], ["y", "x"], 2.0, {"y": F.lit(0.0), "x": F.lit(1.0)}, 0.5).collect())
    half = float(np.sqrt(0.5))
    assert [(k, i, y, x) for k, i, y, x, *_ in got] == [(0, 1, 2.0, 0.5), (0, 2, 3.0, 1.5)]
    assert np.allclose([r[4:] for r in got], [[1, 0], [half, half]])


def test_camera_slows_in_curves_and_stands_at_its_ends(spark):
    line = [(0, i, 0.0, 0.0, 10.0 * i, 0.0, 0.0, 10.0 * i + 5, 0.0, 1.0, 0.0) for i in range(5)]
    bend = [(1, i, 0.0, float(8 * np.sin(a)), float(8 * np.cos(a)), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0) for i, a in enumerate(np.linspace(0, 2.5, 5))]
    still = [(2, i, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.0, 1.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(line + bend + still, "track bigint, i bigint, pz double, py double, px double, fz double, fy double, fx double, uz double, uy double, ux double")
    got = builds.camera_track(df).toPandas()
    for k, rows in ((0, line), (1, bend)):
        t = got[got.track == k].sort_values("frame")
        p = t[["pz", "py", "px"]].to_numpy()
        assert np.allclose(p[0], rows[0][2:5], atol=1e-6) and np.allclose(p[-1], rows[-1][2:5], atol=1e-3)
        pace = np.linalg.norm(np.diff(p, axis=0), axis=1)
        cruise = np.linalg.norm(np.diff(np.array([r[2:5] for r in rows]), axis=0), axis=1).sum() / (4 * 12) * builds.CRUISE
        assert pace.max() <= cruise * 1.05 and pace[0] < cruise / 4 and pace[-1] < cruise / 2
        assert np.abs(np.diff(pace[:-1])).max() <= cruise / 24 * 1.3
        assert t.keyframe.is_monotonic_increasing
        look = t[["fz", "fy", "fx"]].to_numpy() - p
        up = t[["uz", "uy", "ux"]].to_numpy()
        assert np.allclose((look * up).sum(1), 0, atol=1e-6) and np.allclose(np.linalg.norm(up, axis=1), 1)
    straight = got[got.track == 0].sort_values("frame")["px"].to_numpy()
    assert (np.diff(straight) >= -1e-9).all()
    s = got[got.track == 2]
    assert len(s) == 24 and (s.px == 1).all()


def test_visibility_runs_no_window_to_the_end_of_a_track(spark):
    """Such a frame is gone through anew for each row: a track of a million frames would never end."""
    rows = spark.createDataFrame([(0, i, "a", i > 80, 0.0 if i % 9 > 2 else 5.0) for i in range(200)], "track bigint, frame bigint, mode string, lames boolean, turn double")
    out = timelines.visibility(rows, ["track"], 2, calm_s=1.0)
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().analyzed().toString()
    assert {(r.kind, r.start, r.stop) for r in out.collect()} == {("mode", 70, 82), ("lames", 84, 90), ("fixed", 128, 138)}
