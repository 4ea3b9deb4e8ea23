"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a benchmark question asked with other values still has
the same words. Every window of ``SPAN`` canonical words of an item is joined by hash with every window of a document;
an item of fewer words is one window of its own length. Windows that agree on the item and the offset count together
when their slots are consistent: one value of the item stands for one value in the document. Windows with the item's
own values are not asked for that, and count alone where the others are not consistent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.rules import _let, window_hashes
from quire.llm.tables import free_name

SPAN = 8
#: Words in common that are a leak of any item, and words of an item from which on that many are needed.
ENOUGH, LONG = 12, 22
#: Windows of the benchmark up to which they are broadcast; beyond, both sides are shuffled by hash.
BROADCAST_ROWS = 400_000
#: Windows of the benchmark up to which texts without any of them are passed over before their windows become rows.
LISTED = 50_000
_SLOT = "ǂ"
#: Units of measure. Fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml cl l gal ms s sec min h hr hrs hour hours day days week weeks month months year years km/h mph hz khz mhz ghz kb mb gb tb w kw mw v a k c f usd eur gbp dollars euros pounds percent degrees meters metres kilometers kilometres miles grams kilograms liters litres seconds minutes"
_PUNCTUATION = ".,;:!?\"'()[]{}&%$#*|<>=+~^`_/\\-–—‘’“”«»…"


def _split(text: Column) -> Column:
    """Words in lower case without punctuation; none is empty."""
    return F.filter(F.split(F.translate(F.lower(text), _PUNCTUATION, ""), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _masked(text: Column) -> Column:
    """``text`` with each number, name (a capital within a sentence) and unit after a number as a placeholder word."""
    out = F.regexp_replace(text, r"(?<=[\p{Ll},;] )\p{Lu}[^\x20\x09-\x0D]*", _SLOT + "name")
    out = F.when(out.rlike("[0-9]"), F.regexp_replace(out, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", _SLOT + "num")).otherwise(out)
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    return F.when(F.contains(out, F.lit(_SLOT + "num")), F.regexp_replace(out, rf"(?<={_SLOT}num )(?:{units})(?=[\x20\x09-\x0D.,;:!?)]|$)", _SLOT + "unit")).otherwise(out)


def _hashed(text: Column, sizes: list[int]) -> Column:
    """Canonical words ``c``, plain words ``r`` and, for each size, the hashes ``h`` of the windows at every word."""

    def cut(x: Column) -> Column:
        by_size = F.array(*[F.struct(F.lit(k).alias("k"), window_hashes(x["c"], k).alias("h")) for k in sizes])
        return F.when(F.size(x["c"]) == F.size(x["r"]), F.struct(x["c"].alias("c"), x["r"].alias("r"), by_size.alias("by")))

    def both(masked: Column) -> Column:
        # without placeholders the two word lists are one
        return F.when(F.contains(masked, F.lit(_SLOT)), F.struct(_split(masked).alias("c"), _split(text).alias("r"))).otherwise(_let(_split(text), lambda w: F.struct(w.alias("c"), w.alias("r"))))

    return _let(_let(_masked(text), both), cut)


def _windows(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """``key``, the words, and size ``k``, place ``pos`` (from 1) and hash ``h`` of each window."""
    # explode_outer: for explode, the optimizer adds a filter on the words (one that it infers from the join is left)
    each = rows.select(key, _hashed(F.col("text"), sizes).alias("x")).select(key, "x.c", "x.r", F.explode_outer("x.by").alias("y"))
    each = each.select(key, "c", "r", F.col("y.k").alias("k"), F.posexplode("y.h").alias("p", "h"))
    return each.select(key, "c", "r", "k", (F.col("p") + 1).alias("pos"), "h")


def _sliced(windows: DataFrame, key: list[str]) -> DataFrame:
    """The words of each window alone, and the plain words before and after it."""
    beside = [F.get("r", F.col("pos") - 2).alias("prev"), F.get("r", F.col("pos") + F.col("k") - 1).alias("next")]
    return windows.select(*key, "k", "pos", "h", *[F.slice(w, F.col("pos"), F.col("k")).alias(w) for w in "cr"], *beside)


def _items(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Windows of the items, and their sizes: ``SPAN``, and below it those that an item has as a whole."""
    texts = benchmark.select(F.col("item_id").alias("item"), "text").where("item is not null and text is not null")
    sized = texts.withColumn("words", F.size(_split(F.col("text")))).where("words > 0")
    short = sized.where(F.col("words") < SPAN).select("words").distinct().collect()  # SPAN - 1 at most
    sizes = [SPAN, *sorted(r["words"] for r in short)]
    # in a document the first word can stand after a small letter, which makes a capital a name
    inside = sized.withColumn("text", F.concat(F.lit("a "), F.col("text"))).withColumn("first", F.lit(2))
    sized = sized.withColumn("first", F.lit(1)).unionByName(inside).withColumn("id", F.struct("item", "words", "first"))
    found = _sliced(_windows(sized, "id", sizes), ["id"]).select("id.*", "k", "pos", "h", "c", "r", "prev", "next")
    found = found.where((F.col("k") == F.least(F.lit(SPAN), F.col("words"))) & ((F.col("first") == 1) | (F.col("pos") == 2)))
    place = F.col("pos") - F.col("first") + 1
    before = F.when(place > 1, F.col("prev"))
    bare = ~F.exists("c", lambda w: ~F.startswith(w, F.lit(_SLOT)))
    names = [F.col("c").alias("ic"), F.col("r").alias("ir"), before.alias("iprev"), F.col("next").alias("inext"), bare.alias("bare")]
    return found.select("item", "words", place.alias("ipos"), "h", *names).distinct(), sizes


def leaks(docs: DataFrame, benchmark: DataFrame, listed: int = LISTED) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_words, first_word)``: each document and item it holds a passage of.

    An item counts where the windows that agree at one offset cover ``ENOUGH`` words; one window is enough if the item
    has under ``LONG`` words, since what stands around a copy may change the form of its first and last words, and an
    item under ``SPAN`` words has one window, the whole of it. A window of placeholders alone counts only with the
    item's own words. ``n_words`` is the most words covered at one offset, ``first_word`` the place of the first, from
    0. Null ``doc_id`` or ``item_id`` and null texts give no row. Repeated rows count once; an empty table on either
    side gives an empty one. Other columns are not read. The benchmark is broadcast up to a checked number of windows, and
    up to ``listed`` of them also make a first filter on the texts, which changes no row; the plan on the driver holds them.
    """
    items, sizes = _items(benchmark)
    small = items.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("doc"), "text").where("doc is not null and text is not null")
    known = [r["h"] for r in items.select("h").distinct().limit(listed + 1).collect()] if small and listed else []
    if 0 < len(known) <= listed:
        among = f"exists(filter(by, y -> y.h is not null), y -> exists(y.h, x -> x in ({', '.join(f'{h}L' for h in known)})))"
        texts = texts.withColumn("by", _hashed(F.col("text"), sizes)["by"]).where(F.expr(among)).select("doc", "text")
    found = _windows(texts, "doc", sizes)
    # After a broadcast, the words are cut out for hits alone. Explode, join and cut are compiled as one up to the
    # distinct, so that no row holds a whole text; functions with a lambda would part them.
    if small:
        hits = found.join(F.broadcast(items), "h")
        hits = _sliced(hits, ["doc", *[c for c in items.columns if c != "h"]])
    else:
        hits = _sliced(found, ["doc"]).join(items, "h")
    # an equality would become a join key, to be cut out of every window
    hits = hits.where((F.col("c") <= F.col("ic")) & (F.col("c") >= F.col("ic")) & (~F.col("bare") | (F.col("r") == F.col("ir"))))
    same = [F.coalesce(F.col(x) == F.col(f"i{x}"), F.lit(False)).cast("int").alias(x) for x in ("prev", "next")]
    hits = hits.select("doc", "item", "words", "k", (F.col("pos") - F.col("ipos")).alias("shift"), "pos", "c", "r", "ir", *same).distinct()
    slots = F.expr(f"transform(filter(sequence(0, k - 1), i -> startswith(c[i], '{_SLOT}')), i -> struct(ir[i] as a, r[i] as b))")
    hits = hits.select("doc", "item", "words", "k", "shift", "pos", slots.alias("slots"), (F.col("r") == F.col("ir")).alias("own"), "prev", "next")
    # a word at either end may be the same in another form
    ends = lambda x: F.min(F.when(x, F.struct("pos", (-F.col("prev")).alias("no"))))["no"] * -1 + F.max(F.when(x, F.struct("pos", "next")))["next"]
    places = lambda x: F.struct(F.sort_array(F.collect_set(F.when(x, F.col("pos")))).alias("at"), ends(x).alias("beside"))
    runs = hits.groupBy("doc", "item", "words", "k", "shift").agg(
        places(F.lit(True)).alias("any"), places(F.col("own")).alias("own"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("own"), F.col("slots"))))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    runs = runs.withColumn("consistent", consistent).withColumn("use", F.when(F.col("consistent"), F.col("any")).otherwise(F.col("own")))
    runs = runs.select("doc", "item", "words", "k", "consistent", "use.*").where(F.size("at") > 0)
    steps = F.expr("transform(sequence(1, size(at)), i -> least(k, coalesce(get(at, i) - at[i - 1], k)))")
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + F.col("beside")
    need = F.when(F.col("consistent") & (F.col("words") < LONG), F.col("k")).otherwise(F.least(F.lit(ENOUGH), F.col("words")))
    good = runs.withColumn("n", covered).where(F.col("n") >= need)
    return good.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.sum(F.size("at").cast("long")).alias("n_windows"), F.max("n").cast("long").alias("n_words"), (F.min(F.col("at")[0]) - 1).cast("long").alias("first_word")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; columns unchanged."""
    name = free_name(docs, "_quire_hit")
    # in a pipeline the driver holds the other stages' plans too, so the windows stay out of this one
    hit = leaks(docs, benchmark, listed=0).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"] == hit[name], "left_anti")
