"""Before and after: integrity gates, set checks, span alignment, decisions, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters whose presence makes a changed text a risk. Fixed values.
NEGATIONS = "不未非无莫勿否别没弗毋無沒微靡"
NUMERALS = "〇零一二三四五六七八九十百千萬万億亿兩两壹贰貳叁肆伍陆陸柒捌玖拾佰仟"
UNITS = "年月日時时分秒刻尺寸丈斤两兩钱錢升斗石里步亩畝页頁卷篇章节節"
SYMBOLS = "，。、；：？！—…（）《》“”‘’,.;:?!-()[]"
#: Kinds of candidates that are transcriptions. Fixed values.
TRANSCRIPTIONS = ("NATIVE_TEXT", "PRIMARY_OCR", "CROP_OCR", "VISION_TRANSCRIPTION")


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows lost, added or changed: ``keys..., reason``; equal rows give none. Nulls are equal to each other."""
    a = before.select(*keys, F.struct(F.col(value).alias("v")).alias("_a"))
    b = after.select(*keys, F.struct(F.col(value).alias("v")).alias("_b"))
    reason = F.when(F.col("_b").isNull(), "LOST").when(F.col("_a").isNull(), "ADDED").when(~F.col("_a.v").eqNullSafe(F.col("_b.v")), "CHANGED")
    return a.join(b, keys, "full").select(*keys, reason.alias("reason")).where("reason is not null")


def coverage(sources: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Sources not used exactly once: ``key, times`` (0: lost)."""
    n = used.groupBy(key).agg(F.count("*").alias("times"))
    return sources.select(key).join(n, key, "left").select(key, F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")


def is_permutation(a: Column, b: Column) -> Column:
    """The same items, each once, in any order."""
    return (F.array_sort(a) == F.array_sort(b)) & (F.size(F.array_distinct(a)) == F.size(a))


def overlaps(spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """Pairs of overlapping spans ``start, end`` of one key, ``a`` before ``b``: a range join within the key."""
    a = spans.select(*by, F.col(name).alias("a"), F.col("start").alias("a0"), F.col("end").alias("a1"))
    b = spans.select(*by, F.col(name).alias("b"), F.col("start").alias("b0"), F.col("end").alias("b1"))
    return a.join(b, by).where("a < b and a0 < b1 and b0 < a1").select(*by, "a", "b")


def alignment(claim0: Column, claim1: Column, target0: Column, target1: Column) -> Column:
    return F.when((claim0 == target0) & (claim1 == target1), "EXACT").when((claim0 <= target0) & (claim1 >= target1), "EXPANDED_SPAN").otherwise("UNALIGNED")


def candidates(found: DataFrame, by: list[str], text: str, kind: str, priority: list[str], most: int = 6) -> DataFrame:
    """Distinct texts of a span with all kinds that gave them, the best kind first, ``most`` kept and the rest marked dropped."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    merged = found.groupBy(*by, text).agg(F.min(rank).alias("rank"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank", text))
    return merged.withColumn("place", place).withColumn("dropped", F.col("place") > most).drop("rank")


def _holds(text: Column, characters: str) -> Column:
    return text.rlike("[" + "".join("\\" + c if c in "[]()-" else c for c in characters) + "]")


def risks(before: Column, after: Column) -> Column:
    """Names of the kinds of characters that either of two different texts holds; equal texts have none, null is empty."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    either = lambda f: (a != b) & (f(a) | f(b))
    kinds = {
        "NEGATION": lambda t: _holds(t, NEGATIONS), "NUMERIC": lambda t: t.rlike(r"\p{Nd}") | _holds(t, NUMERALS),
        "SYMBOL": lambda t: _holds(t, SYMBOLS), "UNIT": lambda t: _holds(t, UNITS),
    }
    return F.array_compact(F.array(*[F.when(either(f), name) for name, f in kinds.items()]))


def verdict(case: Column, sure: float = 0.9, margin: float = 0.2, doubt: float = 0.2) -> Column:
    """``verdict, reason`` of a decision: the first rule that holds.

    ``case``: cancelled, current, unavailable (why there is no answer, or null), answered, candidates (their number),
    choice (NONE_SUPPORTED, NEED_MORE_EVIDENCE or a candidate's name; null is no choice), found (whether the choice names
    a candidate), alignment, expanded_ok, kind and text of the chosen candidate, conflict, hard (names of hard risks),
    now (the present text), calibrated, top, second (probabilities) and gap (that evidence is missing; null: not asked).
    Risks come before thresholds.
    """
    delta = risks(case["now"], case["text"])
    named = lambda names: F.array_join(F.transform(names, lambda r: F.concat(F.lit("HARD_RISK_"), r)), ",")
    placed = (case["alignment"] == "EXACT") | ((case["alignment"] == "EXPANDED_SPAN") & case["expanded_ok"])
    rules = [
        (case["cancelled"], "CANCELLED", F.lit("CANCELLED_JOB")),
        (~case["current"], "STALE", F.lit("STALE_SNAPSHOT")),
        (case["unavailable"].isNotNull(), "UNAVAILABLE", F.concat(F.lit("UNAVAILABLE_"), case["unavailable"])),
        (~case["answered"], "UNAVAILABLE", F.lit("UNAVAILABLE_PROTOCOL_ERROR")),
        (case["candidates"] == 0, "HUMAN_REQUIRED", F.lit("NO_CANDIDATE")),
        (case["choice"].isNull(), "UNAVAILABLE", F.lit("UNAVAILABLE_PROTOCOL_ERROR")),
        (case["choice"] == "NONE_SUPPORTED", "NONE_SUPPORTED", F.lit("NONE_SUPPORTED")),
        (case["choice"] == "NEED_MORE_EVIDENCE", "NEED_MORE_EVIDENCE", F.lit("NEED_MORE_EVIDENCE")),
        (~case["found"], "UNAVAILABLE", F.lit("UNKNOWN_CANDIDATE")),
        (~placed, "NEED_MORE_EVIDENCE", F.lit("LOCATION_AMBIGUOUS")),
        (~case["kind"].isin(*TRANSCRIPTIONS) | case["text"].isNull(), "CANDIDATES_ONLY", F.lit("SEMANTIC_ONLY")),
        (case["conflict"], "HUMAN_REQUIRED", F.lit("SOURCE_CONFLICT")),
        (F.size(case["hard"]) > 0, "HUMAN_REQUIRED", named(case["hard"])),
        (F.size(delta) > 0, "HUMAN_REQUIRED", named(delta)),
        (~case["calibrated"], "CANDIDATES_ONLY", F.lit("UNCALIBRATED")),
        (case["gap"] > doubt, "NEED_MORE_EVIDENCE", F.lit("EVIDENCE_GAP")),
        ((case["top"] < sure) | (case["top"] - F.coalesce(case["second"], F.lit(0.0)) < margin), "CANDIDATES_ONLY", F.lit("LOW_SEPARATION")),
        (case["text"] == case["now"], "KEEP_CURRENT", F.lit("KEEP_CURRENT")),
    ]
    result = lambda v, r: F.struct(F.lit(v).alias("verdict"), r.alias("reason"))
    first = F.lit(None)
    for holds, name, reason in reversed(rules):
        otherwise = first if holds is not rules[-1][0] else result("RECOMMEND", F.lit("RECOMMEND"))
        first = F.when(F.coalesce(holds, F.lit(False)), result(name, reason)).otherwise(otherwise)
    return first


def valid_choice(p: Column, keys: Column) -> Column:
    """Probabilities by key: exactly the given keys, each within 0 and 1, together 0.99 to 1.01."""
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda s, x: s + x)
    return (F.array_sort(F.map_keys(p)) == F.array_sort(keys)) & F.forall(F.map_values(p), lambda x: x.between(0.0, 1.0)) & total.between(0.99, 1.01)


def metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    """``cases(truth, picked, offered)``: recall of the offer, accuracy given it, share answered; null truth does not count."""
    known = cases.where("truth is not null")
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return known.groupBy(*by).agg(
        F.count("*").alias("cases"), share(F.col("offered"), F.lit(True)).alias("recall"),
        share(F.col("offered") & (F.col("picked") == F.col("truth")), F.col("offered") & F.col("picked").isNotNull()).alias("accuracy"),
        share(F.col("picked").isNotNull(), F.lit(True)).alias("answered"),
    )
