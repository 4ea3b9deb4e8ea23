"""Event-sourced state: latest values, transitions, two-phase logs, totals, budgets, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Stage weights of a work plan; they add up to 100. Fixed values.
STAGES = {"OCR": 30, "STRUCTURE": 20, "REVIEW": 35, "VALIDATING": 10, "PUBLISHING": 5}


def latest(log: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The row of the highest ``seq`` of each key, by a partial-aggregated maximum, not a sort."""
    rest = [c for c in log.columns if c not in by]
    top = log.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return top.select(*by, "_row.*")


def newest(versions: DataFrame, by: list[str], revision: str, keep: int) -> DataFrame:
    """The newest ``keep`` revisions of each key, compared as numbers."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(revision).desc()))
    return versions.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def transitions(log: DataFrame, by: list[str], seq: str, state: str, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each event with the state before it and whether the step is legal; a first event may be in any state."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(seq))
    table = F.create_map(*[x for k, v in sorted(legal.items()) for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    ok = F.col("before").isNull() | F.coalesce(F.array_contains(F.try_element_at(table, F.col("before")), F.col(state)), F.lit(False))
    return log.withColumn("before", before).withColumn("legal", ok)


def two_phase(log: DataFrame, by: list[str], state: str) -> DataFrame:
    """PREPARED rows closed by COMMITTED or NOT_PUBLISHED; both is a contradiction, neither is pending."""
    has = lambda s: F.coalesce(F.bool_or(F.col(state) == s), F.lit(False))
    seen = log.groupBy(*by).agg(has("PREPARED").alias("p"), has("COMMITTED").alias("c"), has("NOT_PUBLISHED").alias("n"))
    outcome = F.expr("case when c and n then 'CONTRADICTION' when not p then 'UNPREPARED' when c then 'COMMITTED' when n then 'NOT_PUBLISHED' else 'PENDING' end")
    return seen.select(*by, outcome.alias("outcome"))


def in_order(log: DataFrame, by: list[str], arrival: str, stamp: str) -> DataFrame:
    """Events whose ``stamp`` exceeds all that arrived before them; later or repeated ones are dropped."""
    high = F.max(stamp).over(Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_high", high).where(F.col("_high").isNull() | (F.col(stamp) > F.col("_high"))).drop("_high")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Totals over ``calls(status, tokens_in, tokens_out, amount)``; unknown tokens and fees are counted apart."""
    n = lambda cond: F.count_if(cond)
    sent = ~F.col("status").isin("CACHE_REUSED", "NOT_SENT", "PREPARED")
    return calls.groupBy(*by).agg(
        n(sent).alias("requests"),
        n(F.col("status") == "SUCCEEDED").alias("succeeded"),
        n(F.col("status") == "FAILED").alias("failed"),
        n(F.col("status").isin("PENDING", "SENT_UNKNOWN", "OUTCOME_UNKNOWN")).alias("pending"),
        n(F.col("status") == "CACHE_REUSED").alias("cache_hits"),
        F.sum(F.when(sent, F.col("tokens_in").cast("decimal(28,0)"))).alias("tokens_in"),
        n(sent & F.col("tokens_in").isNull()).alias("unknown_in"),
        n(sent & F.col("amount").isNull()).alias("unpriced"),
    )


def budget(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Reserved of live attempts against reported of settled ones; released ones count for neither."""
    live = F.col("state").isin("RESERVED", "SUBMITTED", "SENT", "UNKNOWN", "PENDING")
    return attempts.groupBy(*by).agg(F.sum(F.when(live, F.col("reserved"))).alias("reserved"), F.sum(F.when(F.col("state") == "REPORTED", F.coalesce("reported", "reserved"))).alias("reported"), F.count("*").alias("attempts"))


def granted(claims: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """``claims(by, order, refund)`` with ``remaining`` and ``granted``: each claim takes one of ``limit``, unless none is left.

    A refused claim takes nothing, a refund gives one back, to ``limit`` at most; it is granted where it does. Rows pass
    in order, so a key's state is one number, whatever its size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left = None, limit
        for frame in frames:
            rest, done = [], []
            for k, refund in zip(frame[by], frame["refund"], strict=True):
                if k != key:
                    key, left = k, limit
                ok = left < limit if refund else left > 0
                left += (1 if refund else -1) * ok
                rest.append(left)
                done.append(bool(ok))
            yield frame.assign(remaining=rest, granted=done)

    rows = claims.select(by, order, "refund").repartition(by).sortWithinPartitions(by, order)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("remaining", LongType()), StructField("granted", BooleanType())]))


def percent(done: dict[str, tuple[Column, Column]], finished: Column, weights: dict[str, int] = STAGES) -> Column:
    """Weighted progress in whole numbers: each stage cuts down, 99 is the most before the end; ``done``: done and total units."""
    parts = [F.when(total > 0, F.floor(F.lit(weights[s]) * F.least(n, total) / total)).otherwise(0) for s, (n, total) in done.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(finished, 100).otherwise(F.least(F.lit(99), total)).cast("long")
