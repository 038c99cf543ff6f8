"""Readers, writers and streams."""

import json
import os
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattiq.operators import ranking
from lattiq.sources import sinks, volumes
from lattiq.streaming import profiles as streams


def test_tiff_round_trip(spark, tmp_path):
    for dtype in (np.uint8, np.uint16, np.float32):
        v = (np.arange(24).reshape(2, 3, 4) * 3).astype(dtype)
        path = tmp_path / f"{np.dtype(dtype).name}.tif"
        path.write_bytes(volumes.write_tiff(v))
        rows = volumes.read_tiff(spark, str(path)).collect()
        assert {(r.z, r.y, r.x): r.v for r in rows} == {tuple(map(int, i)): float(x) for i, x in np.ndenumerate(v)}
        assert volumes.read_tiff(spark, str(path), above=30).count() == (v > 30).sum()
    spark.dataSource.register(volumes.VoxelTiff)
    df = spark.read.format("voxel_tiff").option("path", str(path)).option("above", "10").load()
    assert df.count() == (v > 10).sum() and df.rdd.getNumPartitions() == 2


def test_region_round_trip(spark, tmp_path):
    pts = [(1.5, 2.25), (10.0, 2.0), (7.75, 9.5)]
    (tmp_path / "a.roi").write_bytes(volumes.write_roi(pts))
    rows = volumes.read_roi(spark, str(tmp_path / "a.roi")).orderBy("i").collect()
    assert [(r.x, r.y) for r in rows] == pts and (rows[0].left, rows[0].top, rows[0].right, rows[0].bottom) == (1, 2, 10, 10)


def test_packets_and_profile(spark, tmp_path):
    (tmp_path / "p.csv").write_text("0.1,0.1,0.02,1000,K\nN/A,1.2,N/A,500,_\n-3,N/A,0.02,250,_\nN/A,N/A,0.1,99,_\n2.5,2.5,0.1,N/A,_\n2.4,2.4,0.1,800,_\nshort\n")
    p = volumes.read_packets(spark, str(tmp_path / "p.csv"))
    assert sorted((r.ts, r.size) for r in p.collect()) == [(0.0, 250), (0.1, 1000), (1.2, 500), (2.4, 800)]
    bins = ranking.packet_bins(p, 1.0)
    assert [(r.bin, r.bytes) for r in bins.orderBy("bin").collect()] == [(0, 1250), (1, 500), (2, 800)]
    sinks.write_profile(bins, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["bin", "start_s", "end_s", "bytes", "kbps", "mbps"]
    assert ranking.packet_bins(p.limit(0), 1.0).count() == 0


def test_axis_keyframes_settings(spark, tmp_path):
    (tmp_path / "axis.txt").write_text("x=1.5\nY=2\nX=3.25\nother\n")
    assert volumes.read_axis(spark, str(tmp_path / "axis.txt")).select("cx", "cy").first() == (3.25, 2.0)
    (tmp_path / "k.json").write_text(json.dumps({"index": 0, "camera": {"position": [1.0, 2.0, 3.0]}, "ui_state": {"view_mode": "a"}}))
    r = volumes.read_keyframes(spark, str(tmp_path / "k.json")).first()
    assert r.legacy and r.actor.scale == [1.0, 1.0, 1.0] and r.camera.position == [1.0, 2.0, 3.0]
    assert volumes.latest(spark, str(tmp_path / "*")).endswith("k.json")
    defaults = spark.createDataFrame([(1, True, 1.0), (2, True, 0.5)], "label int, visible boolean, opacity double")
    given = spark.createDataFrame([(2, False)], "label int, visible boolean")
    assert sorted(map(tuple, volumes.merged_settings(defaults, given, ["label"]).collect())) == [(1, True, 1.0), (2, False, 0.5)]


def test_cache_and_jobs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for p in ({"step": 0.5, "n": 3}, {"n": 3, "step": 0.5 + 1e-9}, {"n": 4, "step": 0.5}):
        assert sinks.cached(spark, str(tmp_path), p, build).count() == 3
    assert len(calls) == 2
    assert sinks.to_do(spark.range(5), spark.range(3), ["id"]).count() == 2
    assert sinks.track_cache(spark.range(1).withColumn("sat", F.lit(0.7))).first().boost == 0.7
    assert sinks.track_cache(spark.range(1)).first().boost == 0.0


def test_names_and_boards(spark):
    df = spark.createDataFrame([("A<b>!c_d.e-f",), ("x" * 40,)], "name string").select(ranking.valid_name(F.col("name")).alias("n"))
    assert [r.n for r in df.collect()] == ["Abc_d.e-f", "x" * 24]
    s = spark.createDataFrame([("g", "b", 5.0, 0), ("g", "a", 5.0, 1), ("t", "c", 9.0, 2), ("t", "d", 3.0, 3)], "game_id string, player_name string, score double, idx bigint")
    games = spark.createDataFrame([("g", "points_desc")], "game_id string, score_type string")
    board = ranking.leaderboard(s, games).orderBy("game_id", "rank").collect()
    assert [(r.game_id, r.player_name, r["rank"]) for r in board] == [("g", "b", 1), ("g", "a", 2), ("t", "d", 1), ("t", "c", 2)]


def _run(df, path, mode="append"):
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    shutil.copy(src, tmp_path / "in" / "events.parquet")
    events = spark.read.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    packets = lambda df: df.select("ts", F.length("props").cast("bigint").alias("size"))
    _run(streams.packet_bins(packets(stream), "1 hour"), tmp_path / "a")
    got = {(r.start, r.bytes, r.n) for r in spark.read.parquet(str(tmp_path / "a/out")).collect()}
    batch = streams.event_time(packets(events)).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bytes", "n")
    want = {tuple(r) for r in batch.collect()}
    assert got <= want and len(want) - len(got) <= 2  # the last windows stay open behind the watermark
    subs = stream.select("ts", (F.col("event_id") % 100).alias("submission_id"))
    _run(streams.submissions(subs, "3650 days"), tmp_path / "b")
    out = spark.read.parquet(str(tmp_path / "b/out"))
    assert out.count() == out.select("submission_id").distinct().count() == 100


def test_catch_game_stream(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0), (2, 5.0, 6.0, 5.0, 6.0, 5.0, 6.0)], "column_id bigint, z0 double, z1 double, y0 double, y1 double, x0 double, x1 double")
    rows = spark.createDataFrame([(7, 0.0, 9.0, 9.0, 9.0), (7, 1.0, 1.0, 1.0, 1.0), (7, 2.0, 1.0, 1.0, 1.0), (7, 130.0, 5.5, 5.5, 5.5), (8, 0.0, 5.5, 5.5, 5.5)], "session bigint, t double, z double, y double, x double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    _run(streams.catch_game(stream, boxes), tmp_path / "c")
    got = sorted((r.session, r.t, r.column_id, r.score) for r in spark.read.parquet(str(tmp_path / "c/out")).collect())
    assert got == [(7, 1.0, 1, 1), (8, 0.0, 2, 1)]


def test_scheduler_stream_equals_its_batch(spark, tmp_path):
    rows = [(s, round(0.1 * k + (3.0 if k > 40 else 0.0), 6), 0.25 + 0.1 * s, (k + s) % 9 != 0) for s in range(3) for k in range(80)]
    shape = "subscriber bigint, t double, period_s double, enabled boolean"
    for i, part in enumerate((rows[:0], [r for r in rows if r[1] < 2.0], [r for r in rows if 2.0 <= r[1] < 6.5], [r for r in rows if r[1] >= 6.5])):
        if part:
            spark.createDataFrame(part, shape).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
            (tmp_path / "in").mkdir(exist_ok=True)
            (f,) = (tmp_path / f"p{i}").glob("*.parquet")
            shutil.copy(f, tmp_path / "in" / f"{i}.parquet")
            os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = _run(streams.scheduled(stream), tmp_path / "s")
    assert q.lastProgress is not None and q.exception() is None
    got = sorted((r.subscriber, r.t) for r in spark.read.parquet(str(tmp_path / "s/out")).collect())
    want = []
    for s in range(3):
        pdf = pd.DataFrame([r for r in rows if r[0] == s], columns=["subscriber", "t", "period_s", "enabled"]).sort_values("t")
        want += [(s, t) for t in streams.fired(pdf, None, 0.0)[0]["t"]]
    assert got == want and len({s for s, _ in got}) == 3 and len(want) < len(rows)


def lzw(data):
    """A writer of TIFF's LZW that clears its table whenever it is full."""
    table, width, bits, before = {bytes([i]): i for i in range(256)}, 9, "", b""
    n, bits = 258, format(256, "09b")
    for i in range(len(data)):
        c = data[i : i + 1]
        if before + c in table:
            before += c
            continue
        bits += format(table[before], f"0{width}b")
        table[before + c] = n
        n += 1
        width = max(9, n.bit_length())
        if n == 4094:
            bits += format(256, "012b")
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        before = c
    bits += format(table[before], f"0{width}b") if before else ""
    n += 1
    bits += format(257, f"0{min(12, max(9, n.bit_length()))}b")
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_compressions():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert volumes.unpackbits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    rng = np.random.default_rng(0)
    for data in (b"", b"aaaa", bytes(range(256)) * 3, rng.integers(0, 4, 30_000).astype(np.uint8).tobytes(), rng.integers(0, 256, 9_000).astype(np.uint8).tobytes()):
        assert volumes.unlzw(lzw(data)) == data
    v = rng.integers(0, 9, (3, 5, 4)).astype(np.uint16)
    data = volumes.write_tiff(v, deflate=True)
    assert np.array_equal(np.stack([volumes.tiff_page(data, t) for t in volumes.tiff_pages(data)]), v)
    rgb = rng.integers(0, 255, (1, 5, 4, 3)).astype(np.uint8)
    data = volumes.write_tiff(rgb)
    assert np.array_equal(volumes.tiff_page(data, volumes.tiff_pages(data)[0]), rgb[0])


def test_records_keep_their_form():
    points = [(1.5, 2.0), (4.25, -3.0), (0.0, 7.5)]
    exact = volumes.write_roi(points)
    assert [(p["x"], p["y"]) for p in volumes.roi_points(exact)] == points and volumes.roi_points(exact)[0]["left"] == 0 and volumes.roi_points(exact)[0]["top"] == -3
    whole = volumes.write_roi(points, exact=False)
    assert [(p["x"], p["y"]) for p in volumes.roi_points(whole)] == [(2, 2), (4, -3), (0, 7)] or [(p["x"], p["y"]) for p in volumes.roi_points(whole)] == [(2, 2), (4, -3), (0, 7 + 1)]
    tail = bytearray(exact) + b"second header"
    tail[60:64] = len(exact).to_bytes(4, "big")
    again = volumes.write_roi([*points, (9.0, 9.0)], like=bytes(tail))
    assert again.endswith(b"second header") and len(volumes.roi_points(again)) == 4 and int.from_bytes(again[60:64], "big") == len(again) - len(b"second header")


def test_small_files_are_sent_together():
    """Rasters and records of one batch come in a few tables, not in one each."""
    class Caught:
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            return f

    rasters = [volumes.write_tiff(np.full((1, 2, 1, 3), k % 256, np.uint8)) for k in range(300)]
    out = list(volumes.panels(Caught(), 2, 1)(iter([pd.DataFrame({"path": [str(k) for k in range(300)], "content": rasters})])))
    assert len(out) == 1 and out[0]["path"].tolist() == [str(k) for k in range(300) for _ in range(2)] and out[0]["g"].tolist() == [k % 256 for k in range(300) for _ in range(2)]
    records = [volumes.write_roi([(k, 1.5), (k + 2, 3)]) for k in range(300)]
    out = list(volumes.roi_rows(Caught())(iter([pd.DataFrame({"path": [str(k) for k in range(300)], "content": records})])))
    assert len(out) == 1 and out[0]["x"].tolist() == [x for k in range(300) for x in (k, k + 2)] and out[0]["i"].tolist() == [0, 1] * 300
