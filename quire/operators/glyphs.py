"""Text blocks from placed glyphs: lines, gaps, words and boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GLYPHS = "book_id string, page_number int, x double, y double, w double, h double, text string"
#: Share of a glyph's size by which two of one line may be off: columns, rows. Fixed values.
OFF_COLUMN, OFF_ROW = 0.8, 0.65
#: A gap that begins a new block: this share of the page, or this many glyphs. Fixed values.
GAP, GAP_GLYPHS = 0.025, 3
#: A gap that is a space between Latin letters or digits, likewise. Fixed values.
SPACE, SPACE_GLYPHS = 0.003, 0.2
LATIN = r"[\p{IsLatin}\p{Nd}]"


def _lines(vertical: bool):
    across, thick, share = ("x", "w", OFF_COLUMN) if vertical else ("y", "h", OFF_ROW)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(_across=-page["x"] if vertical else page["y"], _along=page["y"] if vertical else page["x"])
        page = page.sort_values(["_across", "_along", "text"], kind="stable")
        anchors, line = [], []
        for at, size in zip(page[across], page[thick], strict=True):
            n = next((i for i, (a, s) in enumerate(anchors) if abs(a - at) <= max(s, size) * share), len(anchors))
            if n == len(anchors):
                anchors.append((at, size))
            line.append(n)
        return page.assign(line=line).drop(columns=["_across", "_along"])

    return run


def blocks(glyphs: DataFrame, vertical: bool = False) -> DataFrame:
    """``glyphs`` as in ``GLYPHS`` -> ``book_id, page_number, order, text, bbox``, one row a stretch of a line without a wide gap.

    A glyph belongs to the first line whose first glyph it is level with; lines run from the right if ``vertical``,
    else from the top. One page is one piece of work, and a page's glyphs are few. Stretches without text give no row.
    """
    at, size = ("y", "h") if vertical else ("x", "w")
    lined = glyphs.groupBy("book_id", "page_number").applyInPandas(_lines(vertical), f"{GLYPHS}, line int")
    row = Window.partitionBy("book_id", "page_number", "line").orderBy(at, "text")
    before = lambda c: F.lag(c).over(row)
    lined = lined.withColumns({"_gap": F.col(at) - before(at) - before(size), "_size": F.greatest(F.col(size), before(size)), "_last": F.right(before("text"), F.lit(1))})
    wide = F.col("_gap") > F.greatest(F.lit(GAP), F.col("_size") * GAP_GLYPHS)
    cut = lined.withColumn("_part", F.sum(F.when(wide, 1).otherwise(0)).over(row)).withColumn("_n", F.row_number().over(row))
    if not vertical:
        word = (F.col("_gap") > F.greatest(F.lit(SPACE), F.col("_size") * SPACE_GLYPHS)) & F.col("_last").rlike(LATIN) & F.left("text", F.lit(1)).rlike(LATIN)
        cut = cut.withColumn("text", F.when(word, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    span = lambda c, s: (F.max(F.col(c) + F.col(s)) - F.min(c)).alias(s)
    made = cut.groupBy("book_id", "page_number", "line", "_part").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda g: g["text"]), "")).alias("text"),
        F.struct(F.min("x").alias("x"), F.min("y").alias("y"), span("x", "w"), span("y", "h")).alias("bbox"),
    )
    order = F.row_number().over(Window.partitionBy("book_id", "page_number").orderBy("line", "_part")) - 1
    return made.where("text <> ''").select("book_id", "page_number", order.alias("order"), "text", "bbox")


def union_box(box: Column) -> Column:
    """The smallest box around all of a group."""
    left, top = F.min(box["x"]), F.min(box["y"])
    return F.struct(left.alias("x"), top.alias("y"), (F.max(box["x"] + box["w"]) - left).alias("w"), (F.max(box["y"] + box["h"]) - top).alias("h"))
