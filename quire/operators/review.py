"""Merging recognised fragments, triage of edits and suggestions, reading order, small gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions.labels import least_labels


def sources_of(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``blocks(page, id, source_ids)`` with the sources' texts joined in the order of the sources."""
    ids = blocks.select("page", "id", F.explode("source_ids").alias("source_id"))
    by = ids.join(sources.select("page", "source_id", "order", "text"), ["page", "source_id"]).groupBy("page", "id")
    parts = F.array_sort(F.collect_list(F.struct("order", "text")))
    return by.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.count("*").alias("n"))


def unreferenced(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that no block refers to."""
    used = blocks.select("page", F.explode("source_ids").alias("source_id"))
    return sources.join(used, ["page", "source_id"], "left_anti")


def labels_in_figures(boxes: DataFrame) -> DataFrame:
    """``boxes(page, id, type, bbox)`` -> ``page, id, figure``: the smallest figure that holds a label's centre."""
    figures = boxes.where("type = 'figure'").select("page", F.col("id").alias("figure"), F.col("bbox").alias("outer"))
    pairs = boxes.where("type not in ('figure', 'table', 'formula')").join(figures, "page").where(geo.holds_centre(F.col("outer"), F.col("bbox")))
    return pairs.groupBy("page", "id").agg(F.min_by("figure", F.struct(geo.area(F.col("outer")), "figure")).alias("figure"))


def columns_merged(boxes: DataFrame, tops: float = 0.015, gap: float = 0.04) -> DataFrame:
    """``boxes(page, id, x, y, w, h)`` -> ``page, id, head``: boxes chained by near tops and small gaps, to the fixpoint.

    Pages arrive whole and are worked off many at a time; one page has at most some thousand boxes by its validation rules.
    """

    def chained(table: pa.Table) -> pa.RecordBatch:
        page = table["page"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        ids = table["id"].combine_chunks()
        x, y, w = (table[c].to_numpy() for c in ("x", "y", "w"))
        rank = pc.rank(ids, null_placement="at_end", tiebreaker="first").to_numpy()
        order = np.lexsort((rank, x, page))
        page, x, y, end = page[order], x[order], y[order], (x + w)[order]
        last = np.searchsorted(page, page, "right")
        u, v = [], []
        near, step = np.arange(len(page)), 1
        while len(near := near[near + step < last[near]]):
            a, b = near, near + step
            after = (x[a] <= x[b]) & (x[b] - end[a] <= gap)
            level = (x[a] == x[b]) & (x[a] - end[b] <= gap)
            hit = (np.abs(y[a] - y[b]) <= tops) & (after | level)
            u.append(a[hit])
            v.append(b[hit])
            step += 1
        # nodes in the order of their ids, so that the smallest node of a component is its head
        by_id = np.lexsort((rank[order], page))
        place = np.empty_like(by_id)
        place[by_id] = np.arange(len(by_id))
        none = np.zeros(0, np.int64)
        label = least_labels(*(place[np.concatenate([none, *e])] for e in (u, v)), len(page))
        sorted_ids = ids.take(pa.array(order[by_id]))
        return pa.RecordBatch.from_arrays([table["page"].combine_chunks().take(pa.array(order[by_id])), sorted_ids, sorted_ids.take(pa.array(label))], names=["page", "id", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b for b in batches if b.num_rows):
            page = pa.concat_arrays([*(h.column("page").slice(h.num_rows - 1) for h in held[-1:]), batch.column("page")]).dictionary_encode("encode").indices.to_numpy()
            edges = np.flatnonzero(np.diff(page)) + (0 if held else 1)
            if len(edges):  # up to the last page, which may go on in the next batch
                yield chained(pa.Table.from_batches([*held, batch.slice(0, int(edges[-1]))]))
                held, batch = [], batch.slice(int(edges[-1]))
            held.append(batch)
        if held:
            yield chained(pa.Table.from_batches(held))

    page, name = (boxes.schema[c].dataType.simpleString() for c in ("page", "id"))
    whole = boxes.select("page", "id", "x", "y", "w").repartition("page").sortWithinPartitions("page")
    return whole.mapInArrow(run, f"page {page}, id {name}, head {name}")


def paired(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Two recognitions ``(page, order, id, bbox)`` paired on order by the best overlap, ties by id."""
    joined = a.select("page", "order", "id", F.col("bbox").alias("p")).join(b.select("page", "order", F.col("id").alias("other"), F.col("bbox").alias("q")), ["page", "order"])
    scored = joined.withColumn("iou", geo.iou(F.col("p"), F.col("q"))).where(F.col("iou") >= least)
    best = F.row_number().over(Window.partitionBy("page", "id").orderBy(F.desc("iou"), "other"))
    return scored.withColumn("_r", best).where("_r = 1").select("page", "id", "other", "iou")


def merge_gate(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``page, reason``: pages where merged blocks lose, repeat or alter their sources."""
    used = blocks.select("page", F.explode("source_ids").alias("source_id")).groupBy("page", "source_id").agg(F.count("*").alias("times"))
    seen = sources.select("page", "source_id").join(used, ["page", "source_id"], "full_outer")
    counted = seen.where("times is null or times <> 1").select("page", F.when(F.col("times").isNull(), "LOST").otherwise("REPEATED").alias("reason"))
    unknown = blocks.select("page", F.explode("source_ids").alias("source_id")).join(sources, ["page", "source_id"], "left_anti").select("page", F.lit("UNKNOWN").alias("reason"))
    altered = blocks.join(sources_of(blocks, sources).withColumnRenamed("text", "joined"), ["page", "id"]).where("text <> joined").select("page", F.lit("TEXT").alias("reason"))
    return counted.unionByName(unknown).unionByName(altered).distinct()


def shifted_spans(blocks: DataFrame) -> DataFrame:
    """``blocks(page, group, order, text, spans)`` merged by group in order, spans shifted by the text before them."""
    ahead = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("page", "group").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    moved = blocks.withColumn("_at", ahead).withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("_at")).alias("start"), (s["end"] + F.col("_at")).alias("end"))))
    parts = F.array_sort(F.collect_list(F.struct("order", "text")))
    return moved.groupBy("page", "group").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def reordered(suggested: DataFrame, sources: DataFrame) -> DataFrame:
    """New positions where a page's suggestion names each source exactly once, else the old ones: ``page, source_id, position``."""
    n = suggested.groupBy("page", "source_id").agg(F.count("*").alias("times"), F.min("position").alias("new"))
    joined = sources.select("page", "source_id", F.col("order").alias("old"), F.lit(True).alias("known")).join(n, ["page", "source_id"], "full_outer")
    whole = F.bool_and(F.coalesce(F.col("known"), F.lit(False)) & F.coalesce(F.col("times") == 1, F.lit(False))).over(Window.partitionBy("page"))
    return joined.withColumn("_ok", whole).where("known").select("page", "source_id", F.when(F.col("_ok"), F.col("new")).otherwise(F.col("old")).alias("position"))


def triage(edits: DataFrame, current: DataFrame) -> DataFrame:
    """Imported edits ``(id, base_hash, text)`` against ``current(id, hash, text)``: ``id, outcome``."""
    joined = edits.join(current.select("id", "hash", F.col("text").alias("now")), "id", "left")
    outcome = F.when(F.col("base_hash").isNull() | F.col("text").isNull(), "INVALID").when(F.col("hash").isNull(), "PENDING").when(F.col("text") == F.col("now"), "SAME").when(F.col("hash") == F.col("base_hash"), "APPLIABLE").otherwise("CONFLICT")
    return joined.select("id", outcome.alias("outcome"))


def first_mismatch(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Name of the first pair that differs, in the given order; null if none does."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), name) for name, (a, b) in pairs.items()])


def spread_order(order: Column, box: Column, page_is_spread: Column) -> list[Column]:
    """Sort keys: right half, then left half, on spreads; the given order elsewhere."""
    return [F.when(page_is_spread & (box["x"] + box["w"] / 2 < 0.5), 1).otherwise(0), order]


def folio_pairs(folios: DataFrame) -> DataFrame:
    """Spreads of ``folios(page, side, number)`` whose one right folio is followed by their one left one."""
    r = folios.where("side = 'right'").select("page", F.col("number").alias("r"))
    left = folios.where("side = 'left'").select("page", F.col("number").alias("l"))
    pairs = r.join(left, "page").where("r + 1 = l")
    return pairs.groupBy("page").agg(F.count("*").alias("n"), F.min("r").alias("right"), F.min("l").alias("left")).where("n = 1").drop("n")


def prefers_recognition(chars: Column, covered: Column, ink: Column) -> Column:
    """Whether native text is too thin beside what the page shows."""
    return (chars < 8) | ((chars < 80) & (covered < 0.12) & (ink > 0.01))


def trusted_text(glyphs: DataFrame) -> DataFrame:
    """``glyphs(page, text)`` -> ``page, trusted``: enough of them, and under 2 % unreadable."""
    bad = F.count_if(F.col("text").rlike(r"[\x{FFFD}\x{E000}-\x{F8FF}]"))
    visible = F.count_if(F.length(F.trim("text")) > 0)
    return glyphs.groupBy("page").agg(((F.count("*") >= 8) & (visible >= 12) & (bad < 0.02 * F.count("*"))).alias("trusted"))


def stale(expires: Column, updated: Column, created: Column, now: Column, idle: str = "5 MINUTES") -> Column:
    return F.coalesce(expires <= now, F.lit(False)) | (F.coalesce(updated, created) + F.expr(f"INTERVAL {idle}") <= now)


def retry_after(header: Column, now: Column, most: int = 300) -> Column:
    """Seconds to wait from a number or an RFC 1123 date, at most ``most``; null where it is neither."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(date) - F.unix_timestamp(now)))
    wait = F.coalesce(header.try_cast("long"), ahead)
    return F.when(wait.isNotNull(), F.least(F.lit(most), wait))  # least alone would pass over null


def disjoint_targets(issues: DataFrame, most: int = 3) -> DataFrame:
    """Per block the first ``most`` issues, in the order of their places, that overlap none taken before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, end, n = None, 0, 0
        for frame in frames:
            keep = []
            for k, a, b in zip(frame["block"], frame["start"], frame["end"], strict=True):
                if k != key:
                    key, end, n = k, -1, 0
                take = n < most and a >= end
                end, n = (b, n + 1) if take else (end, n)
                keep.append(take)
            yield frame[keep]

    rows = issues.select("block", "id", "start", "end").repartition("block").sortWithinPartitions("block", "start", "end", "id")
    return rows.mapInPandas(run, rows.schema)


def halves(items: DataFrame, by: str, order: str, least: int = 2) -> DataFrame:
    """Each group cut in two of nearly equal size; groups under ``least`` stay whole."""
    of = Window.partitionBy(by)
    half = F.when(F.count("*").over(of) < least, 1).otherwise(F.ntile(2).over(of.orderBy(order)))
    return items.withColumn("half", half)


def shelf(books: DataFrame, needle: str = "") -> DataFrame:
    """Books that are not archived and whose title or file name holds ``needle``, newest first."""
    text = F.lower(F.concat_ws(" ", "title", "filename"))
    return books.where(~F.coalesce(F.col("archived"), F.lit(False)) & F.contains(text, F.lit(needle.lower()))).orderBy(F.desc("created_at"), "id")


def revision_chain(edits: DataFrame) -> DataFrame:
    """``edits(id, seq, base)`` with ``accepted``: an edit holds if its base is the number of edits accepted before it.

    A fold over one document's edits, whose number its editor bounds.
    """

    def fold(acc: Column, e: Column) -> Column:
        ok = e["base"] == acc["rev"]
        return F.struct(F.when(ok, acc["rev"] + 1).otherwise(acc["rev"]).alias("rev"), F.concat(acc["out"], F.array(F.struct(e["seq"].alias("seq"), ok.alias("accepted")))).alias("out"))

    start = F.expr("named_struct('rev', 0L, 'out', cast(array() as array<struct<seq:bigint,accepted:boolean>>))")
    log = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("base").cast("long").alias("base")))).alias("log"))
    return log.select("id", F.explode(F.aggregate("log", start, fold, lambda a: a["out"])).alias("x")).select("id", "x.*")


def bounded_buffer(events: DataFrame, by: str, seq: str, most: int = 1024, newest: int = 512) -> DataFrame:
    """Keys with more than ``most`` events keep their first one and the ``newest``."""
    of = Window.partitionBy(by)
    marked = events.withColumns({"_n": F.count("*").over(of), "_up": F.row_number().over(of.orderBy(seq)), "_down": F.row_number().over(of.orderBy(F.desc(seq)))})
    return marked.where((F.col("_n") <= most) | (F.col("_up") == 1) | (F.col("_down") <= newest)).drop("_n", "_up", "_down")
