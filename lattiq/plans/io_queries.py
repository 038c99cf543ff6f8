"""Queries of readers and writers: each writes a table or a file of the data and reads it back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators import paths
from lattiq.operators.tables import Workspace, shared_root
from lattiq.plans.base import VOX, query, table, vox
from lattiq.sources import sinks, volumes

ZYX = ["z", "y", "x"]


def _folder(spark, name: str) -> str:
    return Workspace(spark, name).base


def _files(df: DataFrame, n: int, kind: str, deflate: bool) -> DataFrame:
    """path, content: TIFF volumes of four planes each."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros((4, n, n), kind)
        volume[pdf["z"] % 4, pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"path": [str(pdf["slab"].iloc[0])], "content": [volumes.write_tiff(volume, deflate)]})

    return df.withColumn("slab", F.floor(F.col("z") / 4)).groupBy("slab").applyInPandas(pack, "path string, content binary")


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.col("path").cast("bigint") * 4 + F.col("z")).drop("path")


@query(VOX + " SELECT z, y, x, v FROM vox WHERE v > 0")
def tiff_volumes(spark, sf_dir):
    """The volume as compressed float TIFFs, read back above 0."""
    v, n = vox(spark, sf_dir)
    return _whole(volumes.decoded(_files(v, n, "float32", True), 0.0))


@query(VOX + " SELECT c AS label, count(*) AS n FROM vox GROUP BY c")
def tiff_labels(spark, sf_dir):
    """The labels of a label volume kept as TIFFs, and their voxels."""
    v, n = vox(spark, sf_dir)
    found = volumes.labels_of(_whole(volumes.decoded(_files(v.select(*ZYX, F.col("c").alias("v")), n, "uint8", False))))
    return found.filter("label > 0").groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id % 7 AS y, event_id % 256 AS r, event_id * 3 % 256 AS g, event_id * 5 % 256 AS b FROM events")
def rgb_panels(spark, sf_dir):
    """Rasters of 7 by 1 pixels, a file an event; each event looks at a pixel of its own."""

    def pack(batches):
        for pdf in batches:
            raster = np.zeros((7, 1, 3), np.uint8)
            out = []
            for k in pdf["event_id"].tolist():
                raster[:] = 0
                raster[k % 7, 0] = k % 256, k * 3 % 256, k * 5 % 256
                out.append((str(k), volumes.write_tiff(raster[None])))
            yield pd.DataFrame(out, columns=["path", "content"])

    files = table(spark, sf_dir, "events").select("event_id").mapInPandas(pack, "path string, content binary")
    pixels = volumes.panels(files, 7, 1).withColumn("event_id", F.col("path").cast("bigint"))
    return pixels.filter("y = event_id % 7").select("event_id", "y", "r", "g", "b")


@query(VOX + " SELECT z, y, x, v FROM vox")
def volume_table(spark, sf_dir):
    """A scalar field written in planes and read back."""
    path = _folder(spark, "volume")
    sinks.write_by(vox(spark, sf_dir)[0].select(*ZYX, "v"), path, ["z"])
    return spark.read.parquet(path).select(F.col("z").cast("bigint").alias("z"), "y", "x", "v")


@query("WITH f AS (SELECT l_linenumber AS label, l_suppkey % 4 AS cid, count(*) AS n FROM lineitem GROUP BY ALL) SELECT label::BIGINT AS label, cid, n, (sum(n) OVER (ORDER BY label, cid) - n)::BIGINT AS before FROM f")
def mesh_scan(spark, sf_dir):
    """A mesh table in a folder a label and component: the cells of each part, and those before it."""
    path = _folder(spark, "mesh")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("label"), (F.col("l_suppkey") % 4).alias("cid"), F.col("l_orderkey").alias("fid"))
    sinks.write_by(cells, path, ["label", "cid"])
    return sinks.running_totals(spark.read.parquet(path), ["label", "cid"]).select(F.col("label").cast("bigint").alias("label"), F.col("cid").cast("bigint").alias("cid"), "n", "before")


@query(VOX + " SELECT z, y, x, (v / 3)::FLOAT AS vz, c AS speed, CAST(NULL AS DOUBLE) AS t_eikonal FROM vox")
def bundle_table(spark, sf_dir):
    """A field bundle with narrow vectors and an optional column that this one lacks."""
    path = _folder(spark, "bundle")
    bundle = vox(spark, sf_dir)[0].select(*ZYX, (F.col("v") / 3).alias("vz"), F.col("c").alias("speed"))
    sinks.narrowed(bundle, ["vz"]).write.parquet(path)
    return sinks.with_optional(spark.read.parquet(path), {"t_eikonal": "double"})


@query("""WITH s AS (SELECT user_id % 9 AS file, event_id, event_id % 3 AS start, (event_id + user_id) % 3 AS "end", CASE WHEN event_id % 4 = 0 THEN value END AS sat FROM events)
SELECT file, event_id, start, "end", sum(CASE WHEN start <> p THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS path_id, coalesce(sat, 0)::DOUBLE AS boost FROM (SELECT *, lag("end") OVER (PARTITION BY file ORDER BY event_id) AS p FROM s)""")
def track_table(spark, sf_dir):
    """Segments of an old table, without paths and boosts, in today's columns."""
    k = F.col("event_id")
    old = table(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("file"), "event_id", (k % 3).alias("start"), ((k + F.col("user_id")) % 3).alias("end"), F.when(k % 4 == 0, F.col("value")).alias("sat"))
    path = _folder(spark, "tracks")
    old.write.parquet(path)
    return sinks.whole_tracks(spark.read.parquet(path), "event_id").drop("sat")


@query("SELECT o_custkey AS file, o_orderkey AS i, o_custkey % 3 AS path_id, o_orderkey % 97 AS start, coalesce(lead(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey % 97) AS \"end\", 0.0::DOUBLE AS boost FROM orders")
def track_ends(spark, sf_dir):
    """Segments of an older table still, without ends."""
    k = F.col("o_orderkey")
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), k.alias("i"), (F.col("o_custkey") % 3).alias("path_id"), (k % 97).alias("start"))
    return sinks.whole_tracks(old, "i")


@query("WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_orderkey % 24 AS step_id FROM lineitem) SELECT fid, step_id FROM f WHERE step_id % 5 <> 0")
def packed_table(spark, sf_dir):
    """A packed mesh in a folder a step, and its meta as JSON in which every fifth step has a wrong count: those are skipped."""
    root = _folder(spark, "packed")
    f = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), (F.col("l_orderkey") % 24).alias("step_id"))
    sinks.write_by(f, f"{root}/cells", ["step_id"])
    meta = f.groupBy("step_id").agg((F.count("*") + F.when(F.col("step_id") % 5 == 0, 1).otherwise(0)).alias("n"))
    meta.agg(F.to_json(F.struct(F.collect_list(F.struct("step_id", "n")).alias("steps"))).alias("value")).write.text(f"{root}/meta")
    steps = spark.read.text(f"{root}/meta").select(F.inline(F.from_json("value", "steps array<struct<step_id:bigint,n:bigint>>")["steps"]))
    cells = spark.read.parquet(f"{root}/cells").select("fid", F.col("step_id").cast("bigint").alias("step_id"))
    return sinks.checked_steps(cells, steps).select("fid", "step_id")


@query(VOX + " SELECT c AS column_id, min(v::BIGINT) AS first, max(v::BIGINT) AS last FROM vox GROUP BY c")
def cache_levels(spark, sf_dir):
    """The levels that a geometry cache holds of each column; it is built once and then read."""
    v, n = vox(spark, sf_dir)
    parameters = {"n": n, "width": 1.0, "source": sf_dir, "run": _folder(spark, "levels")}
    built = []

    def build():
        if built:
            raise ValueError("the cache was built twice")
        built.append(1)
        return v.select(F.col("c").alias("column_id"), F.col("v").cast("bigint").alias("time_id"), *ZYX)

    for _ in range(2):
        cells = sinks.cached(spark, f"{shared_root(spark)}/cache", parameters, build, ["column_id", "time_id"])
    return sinks.level_ranges(cells).select(*(F.col(c).cast("bigint").alias(c) for c in ("column_id", "first", "last")))


@query("SELECT o_custkey::VARCHAR AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i, (o_orderkey % 83 + 0.5)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y, min(o_orderkey % 83) OVER (PARTITION BY o_custkey)::INTEGER AS \"left\" FROM orders")
def roi_records(spark, sf_dir):
    """Polygons written as region records with half pixels, and read back."""

    def pack(pdf: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        records = [volumes.write_roi(xy) for xy in np.split(pdf[["x", "y"]].to_numpy(), begins[1:])]
        return pd.DataFrame({"path": pdf["k"].to_numpy()[begins].astype(str), "content": records})

    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), k.alias("i"), (k % 83 + 0.5).cast("double").alias("x"), (k % 89).cast("double").alias("y"))
    return volumes.roi_rows(paths.by_track(points, "k", ["i"], pack, "path string, content binary")).select("path", "i", "x", "y", "left")


@query("SELECT event_id, event_type AS mode FROM events")
def session_table(spark, sf_dir):
    """A session table that grows by two appends."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("mode"))
    path = _folder(spark, "session")
    sinks.appended(spark, path, e.filter("event_id % 2 = 0"))
    return sinks.appended(spark, path, e.filter("event_id % 2 = 1"))


@query("SELECT event_id AS id, event_type AS payload FROM events WHERE event_id % 3 <> 0")
def queue_scan(spark, sf_dir):
    """What an offline queue holds once every third entry was sent."""
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("payload"))
    return sinks.dequeued(q, q.filter("id % 3 = 0"))


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS body, CASE WHEN user_id % 2 = 0 THEN 4 ELSE 3 END::INTEGER AS version, user_id % 2 = 0 AS written FROM (SELECT DISTINCT user_id FROM events)")
def document_writes(spark, sf_dir):
    """Documents at version 3: writes that read version 3 go through, those that read version 2 are refused."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    current = users.select("user_id", F.lit("old").alias("body"), F.lit(3).alias("version"))
    new = table(spark, sf_dir, "events").select("user_id", F.lit("new").alias("body"), F.when(F.col("user_id") % 2 == 0, 3).otherwise(2).alias("expected"))
    return sinks.put_document(current, new, ["user_id"])


@query("SELECT bin, round(kbps / 1000, 9)::DOUBLE AS mbps FROM (SELECT event_id % 50 AS bin, sum(value) AS kbps FROM events GROUP BY 1)")
def profile_csv(spark, sf_dir):
    """A rate profile as CSV, read back."""
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).alias("bin")).agg(F.sum("value").alias("kbps"))
    path = _folder(spark, "profile")
    sinks.write_profile(e.select("bin", F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.lit(0).alias("bytes"), "kbps"), path)
    return spark.read.schema("bin bigint, start_s double, end_s double, bytes bigint, kbps double, mbps double").option("header", True).csv(path).select("bin", F.round("mbps", 9).alias("mbps"))


@query("SELECT greatest(coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id * 0.5 - 3 END, CASE WHEN event_id % 3 <> 0 THEN event_id * 0.25 END), 0)::DOUBLE AS ts, event_id AS size FROM events WHERE event_id % 5 <> 0 OR event_id % 3 <> 0")
def packet_lines(spark, sf_dir):
    """Packet lines with missing times, written as text and read back."""
    k = F.col("event_id")
    na = F.lit("N/A")
    path = _folder(spark, "packets")
    lines = F.concat_ws(",", F.when(k % 5 != 0, (k * 0.5 - 3).cast("string")).otherwise(na), F.when(k % 3 != 0, (k * 0.25).cast("string")).otherwise(na), F.lit("0.04"), k.cast("string"), F.lit("K__"))
    short = table(spark, sf_dir, "nation").select(F.lit("short,row").alias("value"))
    table(spark, sf_dir, "events").select(lines.alias("value")).unionByName(short).write.text(path)
    return volumes.read_packets(spark, path).select("ts", "size")


@query("SELECT n_nationkey::BIGINT AS label, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 0.25 END, 1.0)::DOUBLE AS opacity, true AS visible FROM nation")
def settings_merge(spark, sf_dir):
    """Defaults for every label, with the opacity that some settings give."""
    label = F.col("n_nationkey").cast("bigint").alias("label")
    defaults = table(spark, sf_dir, "nation").select(label, F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"))
    given = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(label, F.lit(0.25).alias("opacity"))
    return volumes.merged_settings(defaults, given, ["label"])


@query("SELECT max(name) AS latest FROM (SELECT 'positions_' || lpad(n_nationkey::VARCHAR, 3, '0') || '.json' AS name FROM nation)")
def latest_file(spark, sf_dir):
    """The last of many files by name."""
    path = _folder(spark, "positions")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("positions_"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".json")).alias("name"), F.lit("{}").alias("value"))
    rows.repartition("name").write.partitionBy("name").text(path)
    return spark.createDataFrame([(volumes.latest(spark, f"{path}/*/*.txt").split("name=")[1].split("/")[0],)], "latest string")


@query("SELECT column_id, first_level, n_steps FROM (SELECT l_suppkey % 7 AS column_id, min(l_quantity::BIGINT) AS first_level, count(DISTINCT l_linenumber) AS n_steps FROM lineitem GROUP BY 1)")
def debug_table(spark, sf_dir):
    """A debug dump of columns."""
    path = _folder(spark, "debug")
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("column_id")).agg(F.min(F.col("l_quantity").cast("bigint")).alias("first_level"), F.countDistinct("l_linenumber").alias("n_steps"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) SELECT user_id, event_id, k, sum(1) OVER (PARTITION BY user_id ORDER BY k)::BIGINT AS upto FROM s")
def face_scalars(spark, sf_dir):
    """A scalar a face, written beside the mesh and read back with running numbers."""
    path = _folder(spark, "scalars")
    w = Window.partitionBy("user_id").orderBy("event_id")
    table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("bigint").alias("k")).write.parquet(path)
    return spark.read.parquet(path).withColumn("upto", F.count("*").over(Window.partitionBy("user_id").orderBy("k")))
