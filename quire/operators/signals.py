"""What a page's blocks and texts show: kept lines, diagrams, fallbacks, candidates, unreadable places, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions.text import unique_place

# Patterns, word lists and type lists that decide as named.
NUMBERED = r"^(?:[一二三四五六七八九十百]+[、.．]|[（(][一二三四五六七八九十百0-9]+[)）]|\d+[、.．])"
CONTENTS_ENTRY = r"(?i)^.{1,120}?(?:[.．·•…]{2,}|[—─_-]{3,}|\s/\s*)\s*[（(]?[0-9０-９一二三四五六七八九十百千〇零IVXLCDM]{1,10}[）)]?\s*$"
ENTRY_MARKS = "[，、,。！？!?；;：:]"
ARROWS = r"(?i)[\x{2190}-\x{21FF}\x{27F0}-\x{27FF}\x{2900}-\x{297F}]|\\(?:long)?(?:left|right|up|down|leftright|updown)?arrow\b|\\(?:to|mapsto)\b"
CONNECTOR = r"[|｜¦丨│┃┆┇┊┋╎╏]"
PAGE_TOKEN = r"[0-9]{1,5}|[〇○零一二三四五六七八九十百千兩两廿卅]{2,8}"
ELLIPSIS = r"…{2,}|\.{3,}|．{3,}"
SENTENCE_END = r"[。！？!?]"
UNREADABLE = r"\x{FFFD}+|\x{25A1}+|\x{FFFC}+"
CLOSING = "[”’」』】）》〕〉\"']*$"
ENDS, GOES_ON, CONTINUES = "[。！？!?；;：:.…]" + CLOSING, "[，、,]" + CLOSING, "^[，、,]"
LIST_ITEM, LABEL = r"^(?:[一二三四五六七八九十百]+[、.．]|[（(][一二三四五六七八九十百0-9]+[)）]|\d+[、.．]|[•▪◦●○-]\s)", r"^[^\n：:]{1,12}[：:]"
NEGATIONS = "不未非无無莫勿否别別没沒弗毋"
VISUAL = ("figure", "table", "formula")
TEXTUAL = ("text", "heading", "caption")
SPAN_SOURCE, STRUCTURED_SOURCES = "paddle-span", ("qwen-toc-recovery", "paddle-span")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _rows(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n?|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def _visible(text: Column) -> Column:
    """Code points that are no white space; null counts 0."""
    return F.coalesce(F.length(F.regexp_replace(text, r"\s", "")), F.lit(0))


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind))


def _area(b: Column) -> Column:
    return F.coalesce(F.greatest(b["bbox"]["w"], F.lit(0.0)) * F.greatest(b["bbox"]["h"], F.lit(0.0)), F.lit(0.0))


def is_numbered(text: Column) -> Column:
    """Two lines and more, at least half of them numbered and two at least."""
    return _with(_rows(text), lambda r: _with(F.size(F.filter(r, lambda x: x.rlike(NUMBERED))), lambda n: (n >= 2) & (n * 2 >= F.size(r))))


def is_parallel(text: Column, mode: Column) -> Column:
    """A short heading that ends in a colon over 3 to 12 plain entries of nearly one length, set horizontally."""

    def judged(r: Column) -> Column:
        entries = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
        sizes = F.transform(entries, lambda x: F.length(x))
        shaped = F.length(r[0]).between(2, 13) & r[0].rlike("[：:]$") & ~F.exists(entries, lambda x: x.rlike(ENTRY_MARKS))
        return F.size(r).between(4, 13) & shaped & (F.array_min(sizes) >= 2) & (F.array_max(sizes) <= 18) & (F.array_max(sizes) - F.array_min(sizes) <= 2)

    return (mode == "horizontal-tb") & F.coalesce(_with(_rows(text), judged), F.lit(False))


def is_contents(text: Column) -> Column:
    """Three lines and more, of which seven in ten, and three at least, are a title with a leader and a page."""
    return _with(_rows(text), lambda r: _with(F.size(F.filter(r, lambda x: x.rlike(CONTENTS_ENTRY))), lambda n: (n >= 3) & (n >= 0.7 * F.size(r))))


def keeps_lines(b: Column) -> Column:
    """Whether a block's line breaks are its structure: visuals, recovered contents, numbered, parallel and contents lines."""
    structural = lambda t: F.coalesce(is_numbered(t) | is_parallel(t, b["writing_mode"]) | is_contents(t), F.lit(False))
    given = b["type"].isin(*VISUAL) | b["source"].rlike("^(?:" + "|".join(STRUCTURED_SOURCES) + ")")
    return F.coalesce(given, F.lit(False)) | structural(b["original"]) | structural(b["simplified"])


def is_diagram(text: Column) -> Column:
    """Three lines and four arrows, or four lines of which two are vertical connectors."""
    bar = lambda x: x.rlike(CONNECTOR + r"(?:\s*" + CONNECTOR + "){2}") & (F.length(F.regexp_replace(x, CONNECTOR + r"|\s", "")) <= 2)
    return _with(_rows(text), lambda r: ((F.size(r) >= 3) & (F.regexp_count(text, F.lit(ARROWS)) >= 4)) | ((F.size(r) >= 4) & (F.size(F.filter(r, bar)) >= 2)))


def fallback_mode(blocks: Column, shown_type: Callable[[Column], Column]) -> Column:
    """PAGE_IMAGE where a page's text has no place at all, REGION_IMAGE where a text block is shown as a figure, else NONE."""
    textual = F.filter(blocks, lambda x: x["type"].isin(*TEXTUAL))
    placed = F.exists(textual, lambda x: F.coalesce(geo.valid(x["bbox"]), F.lit(False)))
    region = F.exists(blocks, lambda x: F.coalesce((shown_type(x) == "figure") & ~x["type"].isin(*VISUAL), F.lit(False)))
    return F.when((F.size(textual) > 0) & ~placed, "PAGE_IMAGE").when(region, "REGION_IMAGE").otherwise("NONE")


def figure_only(blocks: Column) -> Column:
    """Some visual block, and no block with a visible character."""
    return F.coalesce(F.exists(blocks, lambda x: x["type"].isin(*VISUAL)) & F.forall(blocks, lambda x: _visible(x["original"]) == 0), F.lit(False))


def claims_full_page(blocks: Column) -> Column:
    """At most three blocks, where the widest visual one takes 82 % of the page and holds 85 % of its characters."""
    big = F.filter(blocks, lambda x: F.coalesce(x["type"].isin(*VISUAL), F.lit(False)) & (_area(x) >= 0.82) & (_visible(x["original"]) > 0))
    top = F.array_max(F.transform(big, lambda x: F.struct(_area(x).alias("area"), _visible(x["original"]).alias("n"))))["n"]
    return F.coalesce((F.size(blocks) <= 3) & (top >= 0.85 * _total(F.transform(blocks, lambda x: _visible(x["original"])), "int")), F.lit(False))


def needs_recovery(blocks: Column) -> Column:
    """No body text, or under 80 characters of it on less than 12 % of the page.

    Areas are added from the smallest up: a sum of doubles depends on its order, and blocks may come in any.
    """
    body = F.filter(blocks, lambda x: ~x["type"].isin("advertisement", "page-number") & (_visible(x["original"]) > 0))
    chars = _total(F.transform(body, lambda x: _visible(x["original"])), "int")
    return F.coalesce((chars == 0) | ((chars < 80) & (_total(F.array_sort(F.transform(body, _area)), "double") < 0.12)), F.lit(True))


def contents_candidate(blocks: Column) -> Column:
    """A page that may be a table of contents: many page numbers and leaders, few sentences, 40 characters at least."""
    text = F.array_join(F.transform(blocks, lambda x: x["original"]), "\n")

    def judged(s: Column) -> Column:
        signals = s["numbers"] + s["leaders"]
        return (s["chars"] >= 40) & (signals >= 5) & ((s["numbers"] >= 5) | (s["leaders"] >= 3)) & (s["sentences"] <= F.greatest(F.lit(2), F.floor(signals / 3)))

    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    folios = F.size(F.filter(blocks, lambda x: x["type"] == "page-number"))
    shown = F.struct(_visible(text).alias("chars"), (n(PAGE_TOKEN) + folios).alias("numbers"), n(ELLIPSIS).alias("leaders"), n(SENTENCE_END).alias("sentences"))
    return F.coalesce(F.exists(blocks, lambda x: F.coalesce(x["source"].startswith(SPAN_SOURCE), F.lit(False))) | _with(shown, judged), F.lit(False))


def awaits_window(status: Column, reviewed: Column, provider: Column, blocks: Column) -> Column:
    """Pending pages, unreviewed and not set by hand, that have no block yet."""
    return F.coalesce((status == "PENDING") & ~F.coalesce(reviewed, F.lit(False)) & ~provider.eqNullSafe(F.lit("manual")) & (F.coalesce(F.size(blocks), F.lit(0)) <= 0), F.lit(False))


def allowed_type(stored: Column, proposed: Column) -> Column:
    """Visual blocks stay as they are; text may become visual; anything else must be a text type."""
    return F.when(stored.isin(*VISUAL), stored).when(stored.isin(*TEXTUAL) & proposed.isin(*VISUAL), proposed).when(proposed.isin(*TEXTUAL), proposed).otherwise(stored)


def window_kinds(text: Column) -> Column:
    """NEGATION and NUMERIC where the text has such a character, PLAIN where it has neither."""
    found = F.array_compact(F.array(F.when(text.rlike(f"[{NEGATIONS}]"), "NEGATION"), F.when(text.rlike(r"\p{Nd}"), "NUMERIC")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("PLAIN")))


def unreadable_runs(blocks: DataFrame, most: int = 128) -> DataFrame:
    """``blocks(page, order, id, text)`` -> ``page, order, id, start, end``: runs of one unreadable character, the first ``most`` of a page.

    Offsets come from the lengths of runs and of what lies between them, so a text costs one scan. Parts that are used
    more than once are variables of lambdas: as columns or in a
    filter of their own, the optimizer would copy each into all of its uses, and again into the constraints of the plan.
    """
    sizes = lambda values: F.transform(values, lambda x: F.length(x))

    def places(gaps: Column, runs: Column) -> Column:
        before = lambda i: _total(F.slice(gaps, 1, i + 1), "int") + _total(F.slice(runs, 1, i), "int")
        return F.transform(runs, lambda n, i: _with(before(i), lambda at: F.struct(at.alias("start"), (at + n).alias("end"))))

    def of(text: Column) -> Column:
        parts = F.struct(sizes(F.split(text, UNREADABLE, -1)).alias("gaps"), sizes(F.slice(F.regexp_extract_all(text, F.lit(UNREADABLE), F.lit(0)), 1, most)).alias("runs"))
        return _with(parts, lambda s: places(s["gaps"], s["runs"]))

    flat = blocks.select("page", "order", "id", F.explode(_with(F.col("text"), of)).alias("p")).select("page", "order", "id", "p.*")
    rank = F.row_number().over(Window.partitionBy("page").orderBy("order", "id", "start"))
    return flat.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def evidence_text(text: Column, issues: Column, longest: int = 256 * 1024, replacement: int = 8192) -> Column:
    """``value, corrected, unresolved`` of a text whose ``issues(start, end, resolved, replacement)`` are settled; null if anything is off.

    Open issues read □; a settled one without a replacement keeps its text. Overlaps, places outside the text and
    oversized parts give null rather than a guess.
    """
    spans = F.array_sort(F.transform(F.array_compact(issues), lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["resolved"].alias("resolved"), i["replacement"].alias("replacement"))))

    def step(acc: Column, s: Column) -> Column:
        sound = (s["start"] >= acc["at"]) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)) & (F.coalesce(F.length(s["replacement"]), F.lit(0)) <= replacement)
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        settled = F.coalesce(s["resolved"], F.lit(False))
        value = F.when(settled, F.coalesce(s["replacement"], own)).otherwise("□")
        return F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), value).alias("out"),
            F.coalesce(s["end"], F.lit(0)).cast("int").alias("at"),
            (acc["ok"] & F.coalesce(sound, F.lit(False))).alias("ok"),
            (acc["corrected"] | (settled & s["replacement"].isNotNull())).alias("corrected"),
            (acc["unresolved"] | ~settled).alias("unresolved"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("ok"), F.lit(False).alias("corrected"), F.lit(False).alias("unresolved"))

    def close(acc: Column) -> Column:
        value = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
        return F.when(acc["ok"] & (F.length(value) <= longest), F.struct(value.alias("value"), acc["corrected"].alias("corrected"), acc["unresolved"].alias("unresolved")))

    return F.when(F.length(text) <= longest, F.aggregate(spans, start, step, close))


def focus(source: Column, shown: Column) -> Column:
    """``prefix, focus, suffix`` of ``shown`` around what differs from ``source``; all of it is the focus if either side has no difference of its own."""

    def common(a: Column, b: Column) -> Column:
        short = F.least(F.length(a), F.length(b))
        same = F.zip_with(F.split(F.left(a, short), ""), F.split(F.left(b, short), ""), lambda x, y: x == y)
        return F.when(short == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, short))

    def cut(left: Column) -> Column:
        def whole(right: Column) -> Column:
            middle = F.length(shown) - left - right
            differs = (middle > 0) & (F.length(source) - left - right > 0)
            some = F.struct(F.left(shown, left).alias("prefix"), F.substring(shown, left + 1, middle).alias("focus"), F.right(shown, right).alias("suffix"))
            return F.when(differs, some).otherwise(F.struct(F.lit("").alias("prefix"), shown.alias("focus"), F.lit("").alias("suffix")))

        rest = lambda t: F.reverse(F.substring(t, left + 1, F.length(t)))
        return _with(common(rest(source), rest(shown)), whole)

    return _with(common(source, shown), cut)


def reading_percent(page: Column, total: Column) -> Column:
    """0 on the first page, 100 on the last and in books of one page; pages outside are moved in; no pages: 0."""
    n = F.greatest(F.coalesce(total, F.lit(0)), F.lit(0))
    at = F.least(n, F.greatest(F.lit(1), F.coalesce(page, F.lit(1))))
    return F.when(n == 0, 0.0).when(n == 1, 100.0).otherwise((at - 1) / F.nullif(n - 1, F.lit(0)) * 100)


def prefetch(pages: DataFrame, centre: Column, reach: int = 5) -> DataFrame:
    """``pages(book_id, page_number, status, revision)``: ready pages within ``reach`` of ``centre``, newest revision each, with their ``priority``.

    The page itself is 0, pages after it come next by distance, then those before it.
    """
    near = pages.where((F.col("status") == "READY") & (F.col("revision") >= 0) & (F.abs(F.col("page_number") - centre) <= reach))
    ahead = F.col("page_number") - centre
    return near.withColumn("priority", F.when(ahead >= 0, ahead).otherwise(2 * reach - ahead)).groupBy("book_id", "page_number", "priority").agg(F.max("revision").alias("revision"))


def open_issues(blocks: DataFrame) -> DataFrame:
    """One row per issue that is not resolved, by page, block order and place: ``page, order, id, issue``."""
    return blocks.select("page", "order", "id", F.explode("issues").alias("issue")).where(~F.coalesce(F.col("issue.resolved"), F.lit(False)))


def accepted_findings(findings: DataFrame, slices: DataFrame) -> DataFrame:
    """``findings(call, block, start, end, quote, reason, inferred)`` held against ``slices(call, block, offset, text)``.

    A finding stands if its quote is at its place, or else at exactly one place of the slice. Places are moved by the
    slice's offset; a proposal equal to the quote is none. ``complete``: whether all findings of the call stand.
    """
    both = findings.join(slices.select("call", "block", "offset", "text"), ["call", "block"], "left")
    quote = F.col("quote")
    sized = F.length(F.trim(quote)).between(1, 256) & (F.length(quote) <= 256) & (F.coalesce(F.length("reason"), F.lit(0)) <= 400) & (F.coalesce(F.length("inferred"), F.lit(0)) <= 256)
    there = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == quote)
    at = F.when(sized & F.col("start").isNotNull() & F.col("end").isNotNull(), F.when(there, F.col("start")).otherwise(unique_place(F.col("text"), quote)))
    placed = both.withColumn("_at", at).withColumn("complete", F.bool_and(F.col("_at").isNotNull()).over(Window.partitionBy("call")))
    begin = F.col("offset") + F.col("_at")
    return placed.where(F.col("_at").isNotNull()).select("call", "block", begin.alias("start"), (begin + F.length(quote)).alias("end"), "reason", F.when((F.trim("inferred") != "") & (F.col("inferred") != quote), F.col("inferred")).alias("inferred"), "complete")


def continues(before: Column, after: Column) -> Column:
    """Whether the text block ``after`` goes on with the sentence of ``before``, by its marks or from the right half to the left one."""
    a, b = F.trim(before["original"]), F.trim(after["original"])
    plain = (before["type"] == "text") & (after["type"] == "text") & ~keeps_lines(before) & ~keeps_lines(after) & (a != "") & (b != "")
    apart = a.rlike(r"\n\s*\n") | b.rlike(r"\n\s*\n") | b.rlike(LIST_ITEM) | b.rlike(LABEL) | a.rlike(ENDS)
    centre = lambda x: x["bbox"]["x"] + x["bbox"]["w"] / 2
    turned = (before["writing_mode"] == "vertical-rl") & (after["writing_mode"] == "vertical-rl") & (centre(before) >= 0.5) & (centre(after) < 0.5)
    return F.coalesce(plain & ~apart & (a.rlike(GOES_ON) | b.rlike(CONTINUES) | F.coalesce(turned, F.lit(False))), F.lit(False))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """``blocks(page, block)`` -> ``page, id, paragraph``: numbers from 0, a new one where a block does not go on with the one before."""
    line = Window.partitionBy("page").orderBy("block.order", "block.id")
    marked = blocks.withColumn("_before", F.lag("block").over(line))
    marked = marked.withColumn("_new", F.when(continues(F.col("_before"), F.col("block")), 0).otherwise(1))
    return marked.select("page", F.col("block.id").alias("id"), (F.sum("_new").over(line) - 1).alias("paragraph"))
