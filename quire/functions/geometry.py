"""Boxes as structs ``x, y, w, h`` in fractions of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(b: Column) -> Column:
    inside = lambda v: v.between(0.0, 1.0) & ~F.isnan(v)
    return F.coalesce(inside(b["x"]) & inside(b["y"]) & (b["w"] > 0) & (b["h"] > 0) & (b["x"] + b["w"] <= 1.000001) & (b["y"] + b["h"] <= 1.000001), F.lit(False))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    return both / F.nullif(area(a) + area(b) - both, F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0.0))


def holds_centre(outer: Column, inner: Column) -> Column:
    cx, cy = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return cx.between(outer["x"], outer["x"] + outer["w"]) & cy.between(outer["y"], outer["y"] + outer["h"])


def normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    left, top = unit(x / width), unit(y / height)
    return F.struct(left.alias("x"), top.alias("y"), (unit((x + w) / width) - left).alias("w"), (unit((y + h) / height) - top).alias("h"))


def in_page(b: Column, region: Column) -> Column:
    """A box of a region's own coordinates, in those of the page."""
    return F.struct((region["x"] + b["x"] * region["w"]).alias("x"), (region["y"] + b["y"] * region["h"]).alias("y"), (b["w"] * region["w"]).alias("w"), (b["h"] * region["h"]).alias("h"))


def edge_zone(b: Column, band: float = 0.12, thick: float = 0.08) -> Column:
    return F.when(b["h"] > thick, None).when(b["y"] + b["h"] <= band, "TOP").when(b["y"] >= 1 - band, "BOTTOM")


def position_bucket(at: Column, step: float = 0.03) -> Column:
    """Nearest step, halves up; not ``round``, which sends negative halves down."""
    return F.floor(at / step + 0.5)


def writing_mode(b: Column) -> Column:
    return F.when(b["h"] > 1.5 * b["w"], "vertical-rl").otherwise("horizontal-tb")


def vertical_order(b: Column) -> list[Column]:
    """Sort keys of vertical text: right half of the spread first, then columns from the right, then down."""
    return [F.when(b["x"] + b["w"] / 2 >= 0.5, 0).otherwise(1), -F.floor((b["x"] + b["w"]) / 0.015), b["y"]]


def tiles(layout: str, share: float = 0.025) -> Column:
    """Four regions (columns, rows or quadrants) that overlap by ``share``, with the core each one owns."""
    grid = {"columns": (4, 1), "rows": (1, 4), "quadrants": (2, 2)}[layout]
    out = []
    for j in range(grid[1]):
        for i in range(grid[0]):
            x, y, w, h = i / grid[0], j / grid[1], 1 / grid[0], 1 / grid[1]
            x0, y0 = max(0.0, x - share), max(0.0, y - share)
            box = {"x": x0, "y": y0, "w": min(1.0, x + w + share) - x0, "h": min(1.0, y + h + share) - y0}
            core = {"x": x, "y": y, "w": w, "h": h}
            out.append(F.struct(*(F.struct(*(F.lit(v).alias(k) for k, v in part.items())).alias(name) for name, part in (("region", box), ("core", core)))))
    return F.array(*out)
