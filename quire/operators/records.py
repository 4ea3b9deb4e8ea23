"""Revisions and their publication, commit recovery, label binding, usage records, chunk context, and small shelves of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values a usage record may hold. Fixed values.
PROVIDERS = ("paddle-aistudio", "ppocr", "qwen", "jev", "minimax")
STATUSES = ("PREPARED", "SENT_UNKNOWN", "PENDING", "OUTCOME_UNKNOWN", "NOT_SENT", "SUCCEEDED", "FAILED", "CACHE_REUSED")
FEES = ("UNKNOWN", "ESTIMATED", "CACHE_REUSE")
CURRENCIES = ("CNY", "USD")
MODEL, OPERATION = "^[A-Za-z0-9][A-Za-z0-9._-]{0,119}$", "^[A-Z][A-Z0-9_]{0,39}$"
#: A page in one of these states is archived when another takes its place.
ARCHIVED = ("READY", "FAILED")
#: A single range is halved from this length on.
HALVED = 200


def revision_of(current: DataFrame, history: DataFrame, revision: int) -> DataFrame:
    """The pages as they were at one revision, from the current table or the archive; the filter reaches both scans."""
    wanted = F.col("revision") == revision
    return current.where(wanted).unionByName(history.where(wanted)).distinct()


def revisions(current: DataFrame, history: DataFrame) -> DataFrame:
    """``page, revision``: what can be read, each once."""
    return current.select("page", "revision").unionByName(history.select("page", "revision")).distinct()


def published(current: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that take the places of pages, one revision up, and the rows that go to the archive.

    A page that was not there keeps its own revision, 0 at least. ``proposed`` holds a page once.
    """
    before = current.select("page", F.col("revision").alias("before"))
    after = F.when(F.col("before").isNull(), F.greatest(F.lit(0), F.coalesce("revision", F.lit(0)))).otherwise(F.col("before") + 1)
    new = proposed.join(before, "page", "left").withColumn("revision", after).drop("before")
    return new, current.where(F.col("status").isin(*ARCHIVED)).join(proposed.select("page"), "page", "left_semi")


def reconciled(commits: DataFrame, pages: DataFrame) -> DataFrame:
    """Prepared commits are held against the published page: committed if it is theirs, not published if it is still the one before."""
    now = pages.select("page", F.col("last_commit_id").alias("_id"), F.coalesce("revision", F.lit(0)).alias("_revision"), F.col("hash").alias("_hash"))
    theirs = (F.col("commit_id") == F.col("_id")) & (F.col("published_revision") == F.col("_revision")) & (F.col("content_hash") == F.col("_hash"))
    former = (F.col("expected_revision") == F.col("_revision")) & (F.col("previous_hash") == F.col("_hash"))
    state = F.when(F.col("state") != "PREPARED", F.col("state")).when(theirs, "COMMITTED").when(former, "NOT_PUBLISHED").otherwise("UNKNOWN")
    return commits.join(now, "page", "left").withColumn("state", state).drop("_id", "_revision", "_hash")


def label_faults(cases: DataFrame, labels: DataFrame, statuses: tuple[str, ...], readable: str = "READABLE_WITH_TRUTH") -> DataFrame:
    """``case_id, reason``: why labels may not be bound to cases; without rows, ``labelled`` is allowed."""
    times = labels.groupBy("case_id").agg(F.count("*").alias("times"))
    known = cases.groupBy("case_id").agg(F.count("*").alias("known"), F.max(F.coalesce(F.col("status") != "UNLABELED", F.lit(False))).alias("before"))
    each = labels.join(times, "case_id").join(known, "case_id", "left")
    blank = F.coalesce(F.trim("truth") == "", F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "UNKNOWN"), F.when(F.col("times") > 1, "REPEATED"), F.when(F.col("known") > 1, "CASE_REPEATED"), F.when(F.col("before"), "LABELLED"),
        F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "STATUS"), F.when((F.col("status") == readable) & blank, "TRUTH_MISSING"),
        F.when((F.col("status") != readable) & F.coalesce(F.col("truth") != "", F.lit(False)), "TRUTH_GIVEN"),
    ))
    return each.select("case_id", F.explode(reasons).alias("reason")).distinct()


def labelled(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """The cases with the status and truth of their label, if they have one."""
    given = labels.select("case_id", F.col("status").alias("_status"), F.col("truth").alias("_truth"))
    return cases.join(given, "case_id", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("truth", F.col("_truth")).drop("_status", "_truth")


def priced_at_start(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Each call with the first rate listed for its provider and model, as it is when the call starts; null without one."""
    first = rates.groupBy("provider", "model").agg(F.min_by("rate", "position").alias("rate"))
    return calls.join(first, ["provider", "model"], "left")


def usage_valid() -> Column:
    """Whether a usage record keeps all rules on its fields; never null."""
    c = F.col
    whole = [c("created_at") <= c("updated_at"), c("model").rlike(MODEL), c("operation").rlike(OPERATION), c("provider").isin(*PROVIDERS), c("status").isin(*STATUSES), c("fee_kind").isin(*FEES)]
    if_given = [(c("page") < 1), (c("tokens_in") < 0), (c("tokens_out") < 0), ~c("currency").isin(*CURRENCIES), (c("amount") < 0)]
    pairs = [(c("fee_kind") == "ESTIMATED") == (c("currency").isNotNull() & c("amount").isNotNull()), (c("status") == "CACHE_REUSED") == (c("fee_kind") == "CACHE_REUSE")]
    out = F.lit(True)
    for rule in [*whole, *pairs]:
        out &= F.coalesce(rule, F.lit(False))
    for fault in if_given:
        out &= ~F.coalesce(fault, F.lit(False))
    return out


def timings(samples: DataFrame) -> DataFrame:
    """``scenario, n, median_ms, min_ms, max_ms``, rounded to a tenth."""
    ms = F.col("duration_ms")
    return samples.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.percentile(ms, 0.5), 1).alias("median_ms"), F.round(F.min(ms), 1).alias("min_ms"), F.round(F.max(ms), 1).alias("max_ms"))


def chunk_context(chunks: DataFrame) -> DataFrame:
    """``context``: the last range of the chunk before and the first of the one after, unless the chunk has them itself."""
    order = Window.partitionBy("page").orderBy("chunk")
    edges = F.array_compact(F.array(F.lag(F.element_at("ranges", -1)).over(order), F.lead(F.col("ranges")[0]).over(order)))
    return chunks.withColumn("context", edges).withColumn("context", F.filter("context", lambda r: ~F.array_contains("ranges", r)))


def halves(ranges: Column) -> Column:
    """The ranges ``(source_id, start, end)`` of a chunk in two parts; a single one is cut in the middle, none if it is short."""
    n, one = F.size(ranges), ranges[0]
    half, mid = F.floor(n / 2).cast("int"), (one["start"] + F.floor((one["end"] - one["start"]) / 2)).cast("long")
    part = lambda a, b: F.array(F.struct(one["source_id"].alias("source_id"), a.alias("start"), b.alias("end")))
    cut = F.when(one["end"] - one["start"] >= HALVED, F.array(part(one["start"], mid), part(mid, one["end"])))
    return F.when(n >= 2, F.array(F.slice(ranges, 1, half), F.slice(ranges, half + 1, n))).when(n == 1, cut)


def evidence_near(pages: DataFrame, reach: int = 2) -> DataFrame:
    """``book, page, near, text``: texts up to ``reach`` pages away, from the chapter's start to before the next chapter.

    ``pages(book, page, chapter, text)``; the range is an equality on the page number, each page being looked for at
    ``2 * reach`` places, so that a long book is dealt by its pages.
    """
    books = Window.partitionBy("book").orderBy("page")
    start = F.max(F.when(F.col("chapter"), F.col("page")))
    bounds = pages.select("book", "page", start.over(books).alias("from"), F.min(F.when(F.col("chapter"), F.col("page"))).over(books.rowsBetween(1, Window.unboundedFollowing)).alias("to"))
    asked = bounds.withColumn("near", F.explode(F.array(*[F.col("page") + d for d in range(-reach, reach + 1) if d])))
    asked = asked.where((F.col("from").isNull() | (F.col("near") >= F.col("from"))) & (F.col("to").isNull() | (F.col("near") < F.col("to"))))
    texts = pages.where(F.trim("text") != "").select("book", F.col("page").alias("near"), "text")
    return asked.join(texts, ["book", "near"]).select("book", "page", "near", "text")


def first_by_key(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """The first row of each key; null keys have none."""
    rest = [c for c in rows.columns if c not in by]
    kept = rows.dropna(subset=by).groupBy(*by).agg(F.min_by(F.struct(*rest), position).alias("_first"))
    return kept.select(*by, "_first.*")


def marks(rows: DataFrame, by: str, page: str) -> DataFrame:
    """The set of marked pages of each key, in order."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(page)).alias("pages"))


def with_preferences(books: DataFrame, preferences: DataFrame, by: str = "book") -> DataFrame:
    """Books with what the reader has set for them, if anything."""
    return books.join(preferences, by, "left")


def shelf(books: DataFrame, by: str) -> DataFrame:
    """Books by ``title`` in the order of Chinese, by ``progress`` (the furthest read first) or by ``created``, the newest first."""
    newest = F.col("created_at").desc()
    if by == "title":
        return books.orderBy(F.collate("title", "zh"))
    done = F.col("processed_pages") / F.greatest(F.lit(1), F.col("total_pages"))
    return books.orderBy(done.desc(), newest) if by == "progress" else books.orderBy(newest)
