"""Logs that are read again: checkpoints and tails, faults of sequence, unfinished work, epochs, reservations, lockouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def resumed(checkpoint: DataFrame, events: DataFrame, by: list[str], seq: str, totals: DataFrame, sums: list[str]) -> DataFrame:
    """``sums`` of a checkpoint plus those of ``totals``, the aggregate of the events beyond it; see ``tail``. Null adds nothing."""
    high = events.groupBy(*by).agg(F.max(seq).alias("_high"))
    joined = checkpoint.select(*by, F.col("applied_through").alias("_old"), *[F.col(c).alias(f"_{c}") for c in sums]).join(totals.select(*by, *sums), by, "full_outer").join(high, by, "left")
    return joined.select(*by, F.greatest("_old", "_high").alias("applied_through"), *[(F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums])


def tail(checkpoint: DataFrame, events: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Events beyond what their key's checkpoint has applied; keys without one give all."""
    seen = checkpoint.select(*by, F.col("applied_through").alias("_through"))
    return events.join(seen, by, "left").where(F.col("_through").isNull() | (F.col(seq) > F.col("_through"))).drop("_through")


def sequence_faults(log: DataFrame, by: list[str], seq: str) -> DataFrame:
    """``GAP`` with the numbers missing before a row's, ``REUSED`` with 0 for each further row of one number."""
    before = F.lag(seq).over(Window.partitionBy(*by).orderBy(seq))
    step = log.select(*by, seq, (F.col(seq) - before).alias("_step")).where((F.col("_step") == 0) | (F.col("_step") > 1))
    return step.select(*by, seq, F.when(F.col("_step") == 0, "REUSED").otherwise("GAP").alias("fault"), F.greatest(F.col("_step") - 1, F.lit(0)).alias("missing"))


def interrupted(log: DataFrame, by: list[str], seq: str, kind: str, terminal: list[str]) -> DataFrame:
    """Final state of each key on replay: its terminal event with the highest number, or INTERRUPTED."""
    over = F.col(kind).isin(*terminal)
    end = F.max_by(F.when(over, F.col(kind)), F.when(over, F.col(seq)))
    return log.groupBy(*by).agg(F.max(seq).alias("last"), F.coalesce(end, F.lit("INTERRUPTED")).alias("state"))


def once(operations: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each operation key, which later ones repeat; a null key is a key."""
    rest = [c for c in operations.columns if c not in key]
    return operations.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row")).select(*key, "_row.*")


def epochs(operations: DataFrame, by: list[str], order: list[str], now: Column, size: int = 4096, kept: str = "30 DAYS") -> DataFrame:
    """``epoch`` of ``size`` operations in ``order``, and ``archived`` for ended ones (``terminal``) older than ``kept``."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    old = F.coalesce(F.col("terminal") & (F.col("updated_at") + F.expr(f"INTERVAL {kept}") < now), F.lit(False))
    return operations.withColumn("epoch", F.floor((number - 1) / size)).withColumn("archived", old)


def fenced(built: DataFrame, log: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Indexes ``built(.., source_seq)`` whose source has not moved since: ``.., publish``."""
    now = log.groupBy(*by).agg(F.max(seq).alias("_now"))
    return built.join(now, by, "left").withColumn("publish", F.col("source_seq").eqNullSafe(F.col("_now"))).drop("_now")


def reclaimed(reservations: DataFrame, is_stale: Column) -> DataFrame:
    """State of stale reservations ``(state, call_id, remote_id)`` and whether each still holds its slot.

    Only one that was never submitted has ended for certain; the outcome of others is unknown, so they keep the slot.
    """
    active = F.col("state") != "TERMINAL_PROVEN"
    unsent = (F.col("state") == "RESERVED") & F.col("call_id").isNull() & F.col("remote_id").isNull()
    unknown = F.col("state").isin("REMOTE_UNKNOWN", "SUBMIT_UNKNOWN")
    state = F.when(~active | ~F.coalesce(is_stale, F.lit(False)) | unknown, F.col("state")).when(unsent, "TERMINAL_PROVEN").otherwise("REMOTE_UNKNOWN")
    return reservations.withColumn("state", state).withColumn("holds_slot", F.col("state") != "TERMINAL_PROVEN")


def lockouts(attempts: DataFrame, by: str, seconds: float = 60.0, most: int = 5) -> DataFrame:
    """``attempts(by, seq, at, ok)`` with ``locked``: after ``most`` failures in a row, attempts within ``seconds`` are refused.

    Refused ones count for nothing; a failure after the lock locks again, a success clears it. Rows pass in order of
    ``at`` and ``seq``, so a key's state is two numbers, whatever its size.
    """
    out = attempts.select(by, "seq", F.col("at").cast("double").alias("at"), "ok")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fails, until = None, 0, float("-inf")
        for frame in frames:
            locked = []
            for k, at, ok in zip(frame[by], frame["at"], frame["ok"], strict=True):
                if k != key:
                    key, fails, until = k, 0, float("-inf")
                locked.append(at < until)
                if at >= until:
                    fails = 0 if ok else fails + 1
                    until = at + seconds if fails >= most else until
            yield frame.assign(locked=locked)

    rows = out.repartition(by).sortWithinPartitions(by, "at", "seq")
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("locked", BooleanType())]))


def signature_revisions(profiles: DataFrame, by: list[str], seq: str, signature: str) -> DataFrame:
    """``revision`` from 1, raised only where the signature differs from the one before."""
    order = Window.partitionBy(*by).orderBy(seq)
    moved = F.when(F.lag(seq).over(order).isNull() | ~F.col(signature).eqNullSafe(F.lag(signature).over(order)), 1).otherwise(0)
    return profiles.withColumn("_moved", moved).withColumn("revision", F.sum("_moved").over(order)).drop("_moved")


def segments(items: DataFrame, by: list[str], order: list[str], begin: Column, end: Column, gap: float) -> DataFrame:
    """``segment`` from 0, a new one where an item begins more than ``gap`` after the furthest end before it."""
    line = Window.partitionBy(*by).orderBy(*order)
    reached = F.max("_end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    cut = items.withColumn("_begin", begin).withColumn("_end", end).withColumn("_cut", F.when(F.col("_begin") - reached > gap, 1).otherwise(0))
    return cut.withColumn("segment", F.sum("_cut").over(line)).drop("_begin", "_end", "_cut")


def scoped(requests: DataFrame, grants: DataFrame, by: list[str], scopes: list[str]) -> DataFrame:
    """The grant of each request by the first scope in ``scopes`` that has one, then the newest: ``grants(.., scope, seq)``."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    best = grants.withColumn("_rank", rank).where(F.col("_rank") > 0)
    rest = [c for c in grants.columns if c not in by]
    return requests.join(best.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("_rank", -F.col("seq"))).alias("grant")), by, "left")


def decided(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues with the decision on the same page and block whose span and quote are theirs: ``issues(page, id, start, end, quote)``."""
    theirs = decisions.select("page", "id", "start", "end", "quote", "seq", "verdict").groupBy("page", "id", "start", "end", "quote").agg(F.max_by("verdict", "seq").alias("verdict"))
    return issues.join(theirs, ["page", "id", "start", "end", "quote"], "left")


def findings_merged(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings of known blocks, one an issue id (the earliest place), as an array by place: ``page, id, issues``."""
    first = findings.groupBy("page", "id", "issue_id").agg(F.min(F.struct("start", "end")).alias("at"))
    issue = F.struct(F.col("at.start").alias("start"), F.col("at.end").alias("end"), F.col("issue_id").alias("issue_id"))
    return blocks.select("page", "id").join(first.groupBy("page", "id").agg(F.array_sort(F.collect_list(issue)).alias("issues")), ["page", "id"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<start:int,end:int,issue_id:string>>")))
