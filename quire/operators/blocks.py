"""Blocks of pages: validation, classification, layout clusters, presentation roles, outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions.text import display_text, edge_text

#: Block types and writing modes that a valid block may have. Fixed values.
TYPES = ("text", "heading", "figure", "table", "caption", "page-number", "formula", "advertisement")
MODES = ("vertical-rl", "horizontal-tb")
PROMOTION = r"购买|購買|资料|資料|低价|低價|优惠|優惠|代购|免费|免費|discount|buy now"
CONTACT = r"微\s*信|wechat|qq\s*[:：]?\s*\d{5,}|电话|電話|v\s*x\s*[:：]|加群"
SENTENCE = r"[。！？；.!?;]"
LEADER = r"(?:\.{3,}|…{2,}|·{3,}|\s{3,})\s*\d{1,4}\s*$"


def exploded(pages: DataFrame) -> DataFrame:
    """One row per block with its page's keys: ``book_id, page_number, status, block``."""
    return pages.select("book_id", "page_number", "status", F.explode("blocks").alias("block"))


def violations(blocks: DataFrame) -> DataFrame:
    """``book_id, page_number, id, reasons`` of blocks that break a rule; valid blocks give no row."""
    b = F.col("block")
    page = Window.partitionBy("book_id", "page_number")
    same = lambda field: F.count("*").over(page.partitionBy("book_id", "page_number", b[field])) > 1
    rules = {
        "DUPLICATE_ID": same("id"),
        "DUPLICATE_ORDER": same("order"),
        "TYPE": ~b["type"].isin(*TYPES),
        "WRITING_MODE": ~b["writing_mode"].isin(*MODES),
        "BBOX": ~geo.valid(b["bbox"]),
        "CONFIDENCE": ~b["confidence"].between(0.0, 1.0),
        "HEADING_LEVEL": ~b["heading_level"].between(1, 6),
        "TEXT_LENGTH": F.length(b["original"]) > 1_000_000,
        "ISSUE_RANGE": F.exists(b["issues"], lambda i: (i["start"] < 0) | (i["end"] <= i["start"]) | (i["end"] > F.length(b["original"]))),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return blocks.select("book_id", "page_number", b["id"].alias("id"), reasons.alias("reasons")).where(F.size("reasons") > 0)


def is_margin_ad(b: Column, text: Column) -> Column:
    """A short line in the top or bottom margin that both promotes and names a contact, and is no sentence."""
    flat = F.lower(F.regexp_replace(text, r"\s+", ""))
    margin = (b["bbox"]["h"] <= 0.06) & ((b["bbox"]["y"] + b["bbox"]["h"] <= 0.10) | (b["bbox"]["y"] >= 0.90))
    return b["type"].isin("text", "heading", "caption") & margin & F.length(flat).between(8, 60) & flat.rlike(PROMOTION) & F.lower(text).rlike(CONTACT) & ~text.rlike(SENTENCE)


def is_folio(text: Column) -> Column:
    """A page number alone, plain or between dashes."""
    return text.rlike(r"^\s*[-–—·]?\s*(?:\d{1,4}|[ivxlc]{1,7}|[一二三四五六七八九十百〇]{1,5})\s*[-–—·]?\s*$")


def is_toc_entry(text: Column) -> Column:
    """A printed table of contents: its title, or three lines and more of which seven in ten end in a page number."""
    rows = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    entries = F.size(F.filter(rows, lambda x: x.rlike(LEADER)))
    return F.trim(text).isin("目录", "目錄", "目次", "contents", "Contents", "CONTENTS") | ((F.size(rows) >= 3) & (entries >= 0.7 * F.size(rows))) | ((F.size(rows) < 3) & text.rlike(LEADER))


def is_matrix(text: Column) -> Column:
    """Unreliable recognised grids: many short lines, few distinct, one of them very frequent."""
    rows = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0)

    def judged(r: Column) -> Column:
        n = F.size(r)
        distinct = F.array_distinct(r)
        top = F.array_max(F.transform(distinct, lambda d: F.size(F.filter(r, lambda x: x == d))))
        short = F.size(F.filter(r, lambda x: F.length(F.trim(x)) <= 2))
        return (n >= 80) & (short >= 0.8 * n) & (F.size(distinct) <= F.greatest(F.lit(10), F.floor(n / 8))) & (top >= F.greatest(F.lit(30), F.floor(n / 5)))

    return F.transform(F.array(rows), judged)[0]


def layout_groups(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, layout_group``: aspect, majority writing mode (ties: the smaller name), parity."""
    votes = exploded(pages).groupBy("book_id", "page_number", F.col("block.writing_mode").alias("mode")).agg(F.count("*").alias("n"))
    mode = votes.groupBy("book_id", "page_number").agg(F.min(F.struct((-F.col("n")).alias("n"), "mode"))["mode"].alias("mode"))
    aspect = F.floor(F.col("width") / F.col("height") * 20 + 0.5).cast("string")
    parity = F.when(F.col("page_number") % 2 == 0, "even").otherwise("odd")
    return pages.select("book_id", "page_number", aspect.alias("aspect"), parity.alias("parity")).join(mode, ["book_id", "page_number"], "left").select("book_id", "page_number", F.concat_ws("/", "aspect", F.coalesce("mode", F.lit("none")), "parity").alias("layout_group"))


def edge_clusters(edges: DataFrame, observed: DataFrame, least_observed: int = 5, least_pages: int = 3, coverage: float = 0.6) -> DataFrame:
    """Running headers and footers.

    ``edges(book_id, layout_group, zone, bucket, text, page_number)`` and ``observed(book_id, layout_group, pages)``
    -> ``book_id, layout_group, zone, bucket, text, page_count, first_page``. Counting is distributed by all keys;
    the cluster's pages are not gathered.
    """
    keys = ["book_id", "layout_group", "zone", "bucket", "text"]
    by = edges.groupBy(*keys).agg(F.count_distinct("page_number").alias("page_count"), F.min("page_number").alias("first_page"))
    wide = by.join(observed, ["book_id", "layout_group"]).where((F.col("pages") >= least_observed) & (F.col("page_count") >= least_pages) & (F.col("page_count") >= coverage * F.col("pages")))
    return wide.select(*keys, "page_count", "first_page")


def presented(blocks: DataFrame, clusters: DataFrame, overrides: DataFrame, titles: DataFrame) -> DataFrame:
    """Role and visibility of each block by the first rule that holds.

    ``blocks(book_id, page_number, layout_group, block)``; ``clusters`` as from ``edge_clusters``;
    ``overrides(book_id, page_number, id, action)``, at most one a block; ``titles(book_id, title)``.
    """
    b = F.col("block")
    text = display_text(b["simplified"], b["original"])
    rows = blocks.withColumn("text", text).withColumn("edge", edge_text(text)).withColumn("zone", geo.edge_zone(b["bbox"])).withColumn("id", b["id"])
    first = clusters.groupBy("book_id", "layout_group", "zone", F.col("text").alias("edge")).agg(F.min("first_page").alias("first_page"))
    rows = rows.join(first, ["book_id", "layout_group", "zone", "edge"], "left").join(overrides, ["book_id", "page_number", "id"], "left").join(titles, "book_id", "left")
    role = (
        F.when(F.col("action") == "SHOW", "BODY").when(F.col("action") == "HIDE", "HIDDEN")
        .when((b["type"] == "page-number") | (F.col("zone").isNotNull() & is_folio(F.col("text"))), "PAGE_NUMBER")
        .when(is_toc_entry(F.col("text")), "PRINTED_TOC")
        .when(b["type"].isin("figure", "table", "formula"), "VISUAL")
        .when((b["type"] == "advertisement") | is_margin_ad(b, F.col("text")), "ADVERTISEMENT")
        .when(b["type"] == "caption", "CAPTION")
        .when((F.col("page_number") == 1) & (F.col("edge") == edge_text(F.col("title"))), "COVER_TITLE")
        .when(F.col("first_page").isNotNull(), F.when(F.col("zone") == "TOP", "RUNNING_HEADER").otherwise("RUNNING_FOOTER"))
        .when(b["heading_level"].isNotNull() | (b["type"] == "heading"), "HEADING").otherwise("BODY")
    )
    rows = rows.withColumn("role", role)
    shown = ~F.col("role").isin("HIDDEN", "PAGE_NUMBER", "ADVERTISEMENT") & ~(F.col("role").isin("RUNNING_HEADER", "RUNNING_FOOTER") & (F.col("page_number") > F.col("first_page")))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(b["heading_level"], F.lit(1))))
    return rows.select("book_id", "page_number", "id", b["order"].alias("order"), "text", "role", F.coalesce(shown, F.lit(True)).alias("show"), (F.col("role") == "HEADING").alias("in_outline"), F.when(F.col("role") == "HEADING", level).alias("level"))


def recall_signals(b: Column) -> Column:
    """Why a block should be looked at again."""
    return F.array_compact(F.array(
        F.when(F.length(b["suggestion"]) > 0, "SUGGESTION"), F.when(b["uncertain"], "UNCERTAIN"), F.when(b["confidence"] < 0.8, "LOW_CONFIDENCE"),
        F.when(b["original"].rlike("[�□￼]"), "PLACEHOLDER"), F.when(F.size(b["source_ids"]) == 0, "MISSING_SOURCE"),
    ))
