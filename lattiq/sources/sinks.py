"""Writers: partitioned meshes and fields, parameter-keyed caches, jobs left to do, CSV profiles."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions import halves


def cache_path(base: str, parameters: dict) -> str:
    """A folder named by its parameters, numbers rounded to six decimals: other parameters never meet stale rows."""
    plain = {k: round(v, 6) if isinstance(v, float) else v for k, v in sorted(parameters.items())}
    return f"{base}/{hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, base: str, parameters: dict, build: Callable[[], DataFrame], by: list[str] = ()) -> DataFrame:
    """The table of these parameters, built first if a finished one is not there."""
    path = cache_path(base, parameters)
    if not exists(spark, path):
        build().write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def to_do(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a done row."""
    return jobs.join(done.select(*keys), keys, "left_anti")


def write_by(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a key, each written by one task."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_profile(bins: DataFrame, path: str) -> None:
    bins.select("bin", "start_s", "end_s", "bytes", "kbps", (F.col("kbps") / 1000).alias("mbps")).orderBy("bin").write.mode("overwrite").option("header", True).csv(path)


def track_cache(df: DataFrame) -> DataFrame:
    """A track table of any age in today's columns: boost falls back on sat, then on 0."""
    have = [F.col(c) for c in ("boost", "sat") if c in df.columns]
    return df.withColumn("boost", F.coalesce(*have, F.lit(0.0)))


def running_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, before: the cells of each part of a mesh scan, and how many stand in the parts before it (a row a part)."""
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("before", F.sum("n").over(Window.orderBy(*keys)) - F.col("n"))


def narrowed(bundle: DataFrame, parts: list[str]) -> DataFrame:
    """A field bundle with its vector parts as 32-bit floats."""
    return bundle.withColumns({c: F.col(c).cast("float") for c in parts})


def with_optional(bundle: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The bundle with a null column for each optional one (name to type) that it lacks."""
    return bundle.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in bundle.columns})


def whole_tracks(segments: DataFrame, by: str) -> DataFrame:
    """Segments of any age in today's columns: missing ends are the next start of the path, missing paths are inferred from
    ends that meet starts, a missing boost falls back. segments: file, by, start, and maybe end, path_id, boost, sat."""
    w = Window.partitionBy("file").orderBy(by)
    if "path_id" not in segments.columns:
        if "end" not in segments.columns:
            raise ValueError("segments without ends and without paths")
        segments = segments.withColumn("path_id", F.sum(F.when(F.col("start") != F.lag("end").over(w), 1).otherwise(0)).over(w).cast("bigint"))
    if "end" not in segments.columns:
        along = Window.partitionBy("file", "path_id").orderBy(by)
        segments = segments.withColumn("end", F.coalesce(F.lead("start").over(along), F.col("start")))
    return track_cache(segments)


def checked_steps(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """The cells of a packed mesh whose steps hold as many cells as meta (step_id, n) says; other steps are left out."""
    n = cells.groupBy("step_id").agg(F.count("*").alias("n"))
    return cells.join(n.join(meta, ["step_id", "n"]).select("step_id"), "step_id", "left_semi")


def level_ranges(cells: DataFrame) -> DataFrame:
    """column_id, first, last: the levels that a cache partitioned by column and level lists."""
    return cells.groupBy("column_id").agg(F.min("time_id").alias("first"), F.max("time_id").alias("last"))


def appended(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds rows to a JSON session table and returns the whole of it."""
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


def dequeued(queue: DataFrame, sent: DataFrame) -> DataFrame:
    """What is left of an offline queue (id, ...) once the ids of `sent` are deleted, in the order of ids."""
    return queue.join(sent.select("id"), "id", "left_anti").orderBy("id")


def put_document(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Documents (keys, body, version) after writes (keys, body, expected: the version read, null for a new one): a write whose
    version is not the current one is refused. Adds written: whether the row comes from a write. Of several writes that
    expect the same version the least body wins, so a replay changes nothing."""
    one = new.groupBy(*keys, "expected").agg(F.min("body").alias("new_body"))
    both = current.join(one, keys, "full")
    fits = F.col("new_body").isNotNull() & F.col("version").eqNullSafe(F.col("expected"))
    rows = both.select(*keys, F.when(fits, F.col("new_body")).otherwise(F.col("body")).alias("body"), F.when(fits, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), fits.alias("written"))
    return rows.filter("version is not null").groupBy(*keys).agg(F.max_by(F.struct("body", "version", "written"), "version").alias("r")).select(*keys, "r.*")


def written_tracks(points: DataFrame, paths: DataFrame, path: str) -> None:
    """Writes a track table: its points, and beside them a row of attributes a path, which comes last."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    paths.write.mode("overwrite").parquet(f"{path}/paths")


def read_tracks(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Points and paths of a track table; points of paths without attributes are left out, as of an unfinished write."""
    paths = spark.read.parquet(f"{path}/paths")
    return spark.read.parquet(f"{path}/points").join(paths.select(key), key, "left_semi"), paths


def written_bundle(df: DataFrame, path: str, parameters: dict, half: list[str] = (), single: list[str] = (), by: list[str] = ()) -> None:
    """Writes a bundle: its columns of `half` as bits of half precision, those of `single` as 32-bit floats, a folder a value of `by`, and its
    parameters beside them. The parameters come last: a bundle without them is not finished."""
    packed = df.withColumns({c: halves.half(F.col(c)) for c in half} | {c: F.col(c).cast("float") for c in single})
    packed.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/cells")
    about = json.dumps({"parameters": parameters, "half": list(half)}, sort_keys=True)
    df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A bundle's rows, halves as doubles, and its parameters."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    cells = spark.read.parquet(f"{path}/cells")
    return cells.withColumns({c: halves.whole(F.col(c)) for c in about["half"]}), about["parameters"]


def resumed(rows: DataFrame, keys: list[str], work: Callable[[tuple, pd.DataFrame], pd.DataFrame], shape: str, path: str, batches: int = 8, most: int | None = None, after_data: Callable[[int], None] = lambda batch: None) -> tuple[DataFrame, DataFrame]:
    """(what the jobs gave, a row a job: keys, status, n_rows, error) of one job for each value of keys over its rows.

    Jobs are dealt to `batches`. A batch's rows are written first and then its lines of the manifest, so rows of a run that ended between
    the two count for nothing. A run leaves out the jobs that the manifest calls done; those that failed are tried again, and an
    exception of one job is its line, not the end of the others. `most` batches are run at most. work gets the keys and a job's rows
    and returns rows of `shape`."""
    spark = rows.sparkSession
    data, manifest = f"{path}/data", f"{path}/manifest"
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    about = "run string, status string, n_rows bigint, error string"

    def lines() -> DataFrame:
        there = spark._jvm.org.apache.hadoop.fs.Path(manifest)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], f"{kinds}, {about}, at bigint")
        return spark.read.schema(f"{kinds}, {about}, at bigint").parquet(manifest)

    def newest() -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("at"), "run")
        return lines().withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    batch_of = F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")
    todo = rows.select(*keys).distinct().join(newest().filter("status = 'done'").select(*keys), keys, "left_anti").select(*keys, batch_of.alias("_batch"))
    waiting = sorted(r["_batch"] for r in todo.select("_batch").distinct().collect())  # `batches` numbers at most
    names = [f.strip().split(" ")[0] for f in shape.split(",")]

    for batch in waiting[:most]:
        run = uuid.uuid4().hex

        columns = [*keys, *(c for c in names if c not in keys), "run", "status", "n_rows", "error"]

        def some(pdf: pd.DataFrame) -> list[pd.DataFrame]:  # whole jobs; it is sent with this batch's run before the next begins
            ends = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)) + 1
            kept, ended = [], []
            for a, b in zip([0, *ends], [*ends, len(pdf)], strict=True):
                mine = pdf.iloc[a:b].reset_index(drop=True)
                key = tuple(mine[k].iloc[0] for k in keys)
                try:
                    out = work(key, mine)
                    about_it = ("done", len(out), None)
                except Exception as e:  # noqa: BLE001  a job's failure is a row
                    out, about_it = None, ("failed", 0, f"{type(e).__name__}: {e}")
                if out is not None and len(out):
                    kept.append(out[names].assign(**{k: v for k, v in zip(keys, key, strict=True) if k not in names}))
                ended.append((*key, run, *about_it))
            blank = dict.fromkeys(("status", "n_rows", "error"))
            rows_of = [pd.concat(kept).assign(run=run, **blank)[columns].astype(object)] if kept else []
            return [*rows_of, pd.DataFrame(ended, columns=[*keys, "run", "status", "n_rows", "error"]).reindex(columns=columns).astype(object)]

        def many(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for pdf in frames:
                if not len(pdf):
                    continue
                other = np.flatnonzero((pdf[keys].to_numpy() != pdf[keys].to_numpy()[-1]).any(1))
                last = int(other[-1]) + 1 if len(other) else 0
                if last or held and tuple(held[-1][keys].iloc[-1]) != tuple(pdf[keys].iloc[-1]):
                    yield from some(pd.concat([*held, pdf.iloc[:last]], ignore_index=True))
                    held = []
                held.append(pdf.iloc[last:])  # a job that may go on
            if held:
                yield from some(pd.concat(held, ignore_index=True))

        others = ", ".join(f for f in shape.split(",") if f.strip().split(" ")[0] not in keys)
        mine = rows.join(todo.filter(F.col("_batch") == batch).drop("_batch"), keys, "left_semi")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        mine.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(many, f"{kinds}, {others}, {about}").write.mode("append").parquet(data)
        after_data(batch)
        new = spark.read.schema(f"{kinds}, {others}, {about}").parquet(data).filter((F.col("run") == run) & F.col("status").isNotNull())
        new.select(*keys, "run", "status", "n_rows", "error", F.unix_micros(F.current_timestamp()).alias("at")).coalesce(1).write.mode("append").parquet(manifest)
    state = newest()
    others = ", ".join(f for f in shape.split(",") if f.strip().split(" ")[0] not in keys)
    if lines().isEmpty():
        return spark.createDataFrame([], f"{kinds}, {others}"), state.drop("run", "at")
    found = spark.read.schema(f"{kinds}, {others}, {about}").parquet(data).filter("status is null")
    done = state.filter("status = 'done'").select(*keys, "run")
    return found.join(done, [*keys, "run"], "left_semi").drop("run", "status", "n_rows", "error"), state.drop("run", "at")
