"""Order-dependent logic: islands, as-of joins, streaks, packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers per key: ``by..., first, last, n``."""
    distinct = df.select(*by, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return distinct.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_island")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, order: list[str], value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before it, by key; null if there is none.

    One shuffle and one sort by key: both sides are stacked and the last value is carried forward, so a key's
    rows stream through and none is paired with another.
    """
    stacked = right.select(*by, on, *order, F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"), F.lit(None).alias("_row"))
    stacked = stacked.unionByName(left.select(*by, on, *order, F.lit(None).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "_side", *order)
    return stacked.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last.v").alias(value))


def last_within(by: list[str], order: list[str], value: Column, rows: int) -> Column:
    """The last non-null value among the ``rows`` rows before this one."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1))


def streaks(df: DataFrame, by: list[str], order: list[str], hit: Column) -> DataFrame:
    """Maximal runs of rows where ``hit`` holds: ``by..., start, length``; ``start`` is the first order key."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_hit", hit).withColumn("_run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    return marked.where("_hit").groupBy(*by, "_run").agg(F.min(order[-1]).alias("start"), F.count("*").alias("length")).drop("_run")


def sessions(df: DataFrame, by: str, ts: str, order: str, gap: str) -> DataFrame:
    """Sessions closed by a pause of more than ``gap``: ``by, session_start, session_end, n``."""
    w = Window.partitionBy(by).orderBy(ts, order)
    new = F.coalesce(F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    marked = df.withColumn("_new", new.cast("int")).withColumn("_session", F.sum("_new").over(w))
    return marked.groupBy(by, "_session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n")).drop("_session")


def suffixed(name: Column, by: list[str], order: list[str]) -> Column:
    """Names made unique per key: the second ``x`` is ``x-2``."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return F.when(n == 1, name).otherwise(F.concat(name, F.lit("-"), n.cast("string")))


def packed(blocks: DataFrame, by: str, most_blocks: int = 12, most_chars: int = 1500) -> DataFrame:
    """Greedy chunks of consecutive blocks: ``by, chunk, first_block, last_block, n_blocks, n_chars``.

    A chunk closes when the next block would exceed either limit; a longer block is a chunk of its own. A fold
    over one document's blocks, in the order of ``block_no``, on rows sorted by document: a document is
    streamed, never gathered.
    """
    sized = blocks.select(by, "block_no", F.length("text").alias("size")).repartition(by).sortWithinPartitions(by, "block_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [by, "chunk", "first_block", "last_block", "n_blocks", "n_chars"]
        now: list | None = None
        for frame in frames:
            out = []
            for key, block, size in frame.itertuples(index=False):
                if now and now[0] == key and now[4] < most_blocks and now[5] + size <= most_chars:
                    now[3], now[4], now[5] = block, now[4] + 1, now[5] + size
                    continue
                chunk = now[1] + 1 if now and now[0] == key else 0
                out += [now] if now else []
                now = [key, chunk, block, block, 1, size]
            yield pd.DataFrame(out, columns=names)
        if now:
            yield pd.DataFrame([now], columns=names)

    return sized.mapInPandas(run, f"{by} long, chunk int, first_block int, last_block int, n_blocks int, n_chars long")
