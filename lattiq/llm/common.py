"""What the corpus operators share: the shared folder, code shipping, batches bounded by bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="lattiq-")
        atexit.register(shutil.rmtree, _local_root[app], ignore_errors=True)
    return f"file://{_local_root[app]}"


#: Spark removes the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Writes df; its shuffle files go at once, as what was written is read from now on."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


class Scratch:
    """Tables written to the shared folder, to cut lineage: they outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        written(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lattiq_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._lattiq_path)
        path.getFileSystem(conf).delete(path, True)


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


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the key and the text, null texts as empty: other columns can clash with nothing."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def by_bytes(batch: pa.RecordBatch, column: str | int = "text", limit: int = 1 << 20):
    """Slices of a record batch whose texts hold about `limit` bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    size = batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column))
    lengths = pa.compute.binary_length(size).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)
