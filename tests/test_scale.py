"""What keeps queries within the disk, memory and time of larger tables."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.llm import common
from lattiq.operators import fields, graph, tables
from lattiq.operators.blocks import BLOCK
from lattiq.plans import builds


@pytest.mark.parametrize("keep", [lambda spark, df: tables.Workspace(spark, "t").keep(df), lambda spark, df: common.Scratch(spark, "t").keep(df)])
def test_a_kept_table_leaves_no_shuffle_files(spark, keep):
    def files() -> int:
        at, n = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), 0
        while at.hasNext():
            n += at.next().getName().startswith("shuffle_")
        return n

    before = files()
    kept = keep(spark, spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 5
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before and kept.count() == 7


def test_a_field_bundle_sends_no_voxels_to_every_executor(spark, monkeypatch):
    """Its area is a small file of many rows, which a join with a few voxels would send through the driver."""
    plans, put = [], tables.written

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        put(df, *rest)

    monkeypatch.setattr(tables, "written", noted)
    n = 6
    area = fields.grid_of(spark, n)
    out = builds.field_bundle(area, area.filter("z = 0"), area.filter(F.col("z") == n - 1), n)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastHashJoin [z" in p]
    assert out.count() == n**3


def test_blocks_of_a_potential_are_not_shuffled(spark):
    """What a bucketed table holds meets its faces where it lies; only these are dealt out."""
    space = tables.Workspace(spark, "t")
    own = space.bucketed(spark.range(40).selectExpr("id % 5 bz", "id % 3 by", "id % 2 bx", "id v"), BLOCK)
    near = space.keep(spark.range(9).selectExpr("id % 5 bz", "id % 3 by", "id % 2 bx", "id w"))
    both = own.groupBy(*BLOCK).cogroup(near.groupBy(*BLOCK)).applyInPandas(lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n bigint")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert both.agg(F.sum("n")).first()[0] == sum(1 for i in range(40) for j in range(9) if (i % 5, i % 3, i % 2) == (j % 5, j % 3, j % 2))
    space.drop(own)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lattiq_")]


def test_traced_ways_are_written_once(spark, monkeypatch):
    rows, put = [], tables.Workspace.keep

    def keep(self, df, *rest):
        out = put(self, df, *rest)
        rows.append(out.count() if "step" in out.columns else 0)
        return out

    monkeypatch.setattr(tables.Workspace, "keep", keep)
    line = spark.range(9).selectExpr("id node", "id - 1 via")
    out = graph.traced(line, spark.range(9).selectExpr("id path_id", "id node"))
    assert out.count() == sum(rows) == 45
