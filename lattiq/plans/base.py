"""Registration of queries with their oracle SQL, and the pseudo-volume made of lineitem."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators.tables import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    """The side of the pseudo-volume: 24 up to 100,000 rows of lineitem (a count of the files' footers), then about eight tenths of
    the cube root of their number, in steps of 8 and 64 at least, so that a volume grows with the table."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(64, 8 * math.floor(math.cbrt(rows) / 10)) if rows > 100_000 else 24


def vox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """z, y, x, v, c: a sparse volume from lineitem, and its side."""
    n = side(spark, sf_dir)
    z, y = F.col("l_orderkey") % n, F.col("l_partkey") % n
    x = (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 5 + F.col("l_orderkey")) % n
    rows = table(spark, sf_dir, "lineitem").select(z.alias("z"), y.alias("y"), x.alias("x"), "l_quantity")
    return rows.groupBy("z", "y", "x").agg(F.max("l_quantity").alias("v"), F.count("*").alias("c")), n


VOX = """WITH p AS (SELECT CASE WHEN count(*) > 100000 THEN greatest(64, 8 * floor(cbrt(count(*)) / 10)) ELSE 24 END::BIGINT AS n FROM lineitem),
vox AS (SELECT l_orderkey % n AS z, l_partkey % n AS y, (l_suppkey * 7 + l_linenumber * 5 + l_orderkey) % n AS x, max(l_quantity) AS v, count(*) AS c FROM lineitem, p GROUP BY ALL)
"""
REC = VOX.replace("WITH p", "WITH RECURSIVE p", 1)
VOX = VOX.rstrip()
REC = REC.rstrip()
