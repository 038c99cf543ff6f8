"""Tables written to the folder that all executors share, to cut the lineage of iterations."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lattiq-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"lattiq-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lattiq-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


#: Spark removes the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, put: Callable[[DataFrameWriter], None], settings: dict[str, str] | None = None) -> None:
    """Writes df, by put, under some settings; its shuffle files go at once, as what was written is read from now on."""
    conf, settings = df.sparkSession.conf, {CLEANUP: "true"} | (settings or {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        put(df.write)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class Workspace:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
        """Writes df, under some settings, and returns a reader of what was written; its folder is in _lattiq_path."""
        self.n += 1
        path = f"{self.base}/{self.n:04d}"
        written(df, lambda w: w.parquet(path), settings)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lattiq_path = path
        return out

    def bucketed(self, df: DataFrame, by: list[str], settings: dict[str, str] | None = None) -> DataFrame:
        """The same, dealt to as many buckets by some columns as there are shuffle partitions: groups by these are read without a shuffle."""
        self.n += 1
        path, name = f"{self.base}/{self.n:04d}", f"lattiq_{uuid.uuid4().hex}"
        many = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        written(df, lambda w: w.format("parquet").bucketBy(many, *by).option("path", path).saveAsTable(name), settings)
        out = self.spark.table(name)
        out._lattiq_path, out._lattiq_table = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        if hasattr(df, "_lattiq_table"):
            self.spark.sql(f"DROP TABLE {df._lattiq_table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lattiq_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def apart(df: DataFrame) -> DataFrame:
    """df as one side of a join that is not to be sent to every executor.

    Spark judges a table by its files, and those of voxels or edges in order are a tenth or less of their rows: joins of
    millions of rows would go through the driver."""
    return df.hint("merge")


def quantiles(df: DataFrame, value: str, shares: list[float], few: int = 10_000, known: tuple | None = None) -> list[float | None]:
    """Exact quantiles of a column, between two values by linear interpolation; nulls are left out, None without values.

    The ranks asked for are closed in on by counts in 1,024 equal bins, again within the bin, until so few different values
    are left that they can come to the driver: no buffer ever holds all values. The column is written first, so what it is
    made of is computed once, and a pass looks at all ranks together. known: count, least, greatest and different values, if the
    caller has counted them on a table that is already written."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    if known is None:
        rows = Workspace(df.sparkSession, "quantiles").keep(rows)
    n, low, high, different = known or rows.agg(F.count("*"), F.min("v"), F.max("v"), F.approx_count_distinct("v")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found: dict[int, float] = {}
    todo = [(float(low), float(high), different, 0, sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)}))]
    while todo:
        for a, b, _, _, ranks in todo:
            found |= dict.fromkeys(ranks, a) if a == b else {}
        todo = [t for t in todo if t[0] < t[1]]
        small, large = ([t for t in todo if (t[2] <= few) == s] for s in (True, False))
        todo = []
        if small:
            inside = F.lit(False)
            for a, b, *_ in small:
                inside = inside | F.col("v").between(a, b)
            most = (few + 1) * len(small)
            values = rows.filter(inside).groupBy("v").count().limit(most).collect()
            if len(values) < most:
                values.sort(key=lambda r: r.v)
                for a, b, _, at, ranks in small:
                    for r in (r for r in values if a <= r.v <= b):
                        found |= {k: r.v for k in ranks if at <= k < at + r["count"]}
                        at += r["count"]
            else:  # the estimate was too low
                large += small
        if large:
            bin_of = None
            for i, (a, b, *_) in enumerate(large):
                here = F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("v") - a) / ((b - a) / 1024)), F.lit(1023)).cast("int").alias("k"))
                bin_of = (F if bin_of is None else bin_of).when(F.col("v").between(a, b), here)
            bins = rows.select("v", bin_of.alias("at")).filter("at is not null").groupBy("at").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("d")).collect()
            for i, (_, _, _, at, ranks) in enumerate(large):
                for r in sorted((r for r in bins if r["at"].i == i), key=lambda r: r["at"].k):
                    if inside := [k for k in ranks if at <= k < at + r.n]:
                        todo.append((r.a, r.b, r.d, at, inside))
                    at += r.n
    out = []
    for p in places:
        x, y = found[math.floor(p)], found[math.ceil(p)]
        out.append(x + (y - x) * (p - math.floor(p)))
    return out
