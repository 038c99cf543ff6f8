"""Exact token totals from a histogram of encoded lengths.

The histogram has a row for each length that occurs, so it answers totals, quantiles and truncated totals
for any context limit without another look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm.bpe import encoder, vocabulary
from lattiq.llm.common import Scratch, by_bytes, ship, texts

#: Lengths of one block of the suffix sums; the blocks are summed first, then the lengths within each.
BLOCK = 1024


def histogram(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, n_docs: how many texts have each encoded length. Each task adds up its own texts first.

    A null or empty text has length 0; repeated rows count as often as they occur; an empty table gives no rows.
    """
    ship(spark)
    data = vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunked = encoder(data.value, pattern)
        held: dict[int, int] = {}
        for whole in batches:
            for batch in by_bytes(whole, limit=8 << 20):
                for length, n in zip(*(x.tolist() for x in np.unique(chunked.lengths(batch.column(0)), return_counts=True)), strict=True):
                    held[length] = held.get(length, 0) + n
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(held), pa.int64()), "n_docs": pa.array(list(held.values()), pa.int64())})

    parts = texts(docs.withColumn("doc_id", F.lit(0))).select("text").mapInArrow(run, "n_tokens bigint, n_docs bigint")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """A row per length L of the histogram, L taken as a context limit.

    docs_at_least, tokens_at_least: texts of L ids or more, and their ids. truncated_tokens: the ids of all
    texts if each is cut after L. share_up_to: the share of texts of at most L ids (the quantile's inverse).
    Two levels: blocks of lengths first (few rows), then the lengths inside a block, so no task sees all rows.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("n_ids", F.col("n_docs") * F.col("n_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("n_ids").over(inside)).join(blocks, "block")
    docs, ids = F.col("d_above") + F.col("d_in"), F.col("t_above") + F.col("t_in")
    return hist.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), ids.alias("tokens_at_least"),
        (F.col("t_all") - ids + F.col("n_tokens") * docs).alias("truncated_tokens"),
        ((F.col("d_all") - docs + F.col("n_docs")) / F.col("d_all")).alias("share_up_to"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens for context limits that need not occur as lengths.

    Between two lengths the total is that of the next greater one, less the difference for each text it holds;
    beyond the greatest it is the full total."""
    parts = []
    for limit in limits:
        near = sums.filter(F.col("n_tokens") >= limit).agg(F.min_by(F.col("truncated_tokens") - F.col("docs_at_least") * (F.col("n_tokens") - limit), "n_tokens").alias("v"))
        total = sums.agg(F.max("tokens_at_least").alias("v"))
        parts.append(near.unionByName(total).agg(F.lit(int(limit)).cast("bigint").alias("limit"), F.coalesce(F.min("v"), F.lit(0)).alias("truncated_tokens")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that this share of the texts does not exceed."""
    asked = [sums.filter(F.col("share_up_to") >= q).agg(F.lit(float(q)).alias("share"), F.min("n_tokens").alias("n_tokens")) for q in shares]
    out = asked[0]
    for x in asked[1:]:
        out = out.unionByName(x)
    return out


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The histogram with its suffix sums; the texts are encoded once.

    Null and empty texts have length 0, repeated rows count as often as they occur, ids play no part (so they may be null),
    and an empty table gives no rows."""
    return suffix_sums(Scratch(spark, "token-counts").keep(histogram(spark, docs, path, pattern), "lengths"))
