"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lexicon import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: (name, ratio as SQL over the counted columns, least, most). A row is kept where every ratio lies within
#: its bounds; a ratio of nothing (0 / 0) is null and passes.
RULES = [
    ("word_length", "word_chars / nullif(n_words, 0)", 2.0, 20.0),
    ("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.35),
    ("capitals", "n_upper / nullif(word_chars, 0)", None, 0.5),
    ("stop_words", "n_stop / nullif(n_words, 0)", 0.02, None),
    ("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
    ("repeated_words", "n_repeat_words / nullif(n_words, 0)", None, 0.3),
]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: the union of ``WINDOW`` words from each such window."""

    def union(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)

    def repeated(order: Column) -> Column:
        n = F.size(order)
        same = F.zip_with(F.slice(order, 2, n), F.slice(order, 1, n - 1), lambda b, a: F.when(b["h"] == a["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    indexed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window and need no sorting
    full = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(full, F.lit(0)).otherwise(_let(_let(indexed, repeated), union))


def window_hashes(words: Column, size: int) -> Column:
    """Hashes of the windows of ``size`` words at every word; null where there are fewer. Each word is hashed once."""

    def paired(apart: int):
        return lambda h: F.slice(F.zip_with(h, F.slice(h, apart + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.size(h) - apart)

    def of(h: Column) -> Column:
        if size & (size - 1):
            return F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(size))))
        out, have = h, 1
        while have < size:  # windows of twice the size from two that meet
            out = _let(out, paired(have))
            have *= 2
        return out

    return F.when(F.size(words) >= size, _let(F.transform(words, lambda w: F.xxhash64(w)), of))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    Null texts count as empty and fail the base rule, as every text of fewer than 20 words does. Lines are cut at
    ``\\n``; a line without a word is none. Repeated rows get equal results; an empty table gives an empty one;
    extra columns are not read. Nothing is shuffled, and a text is worked on within its row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    measured = docs.select("doc_id", text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    drop = lambda what: F.length(F.translate("t", what, ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    counted = measured.select(
        "doc_id",
        F.struct(
            F.size("w").cast("long").alias("n_words"),
            drop(SPACES).cast("long").alias("word_chars"),
            (F.length("t") - drop(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.length("t") - drop("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
            F.size(F.filter("w", lambda x: F.lower(x).isin(stop))).alias("n_stop"),
            _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("new"))).alias("lines"),
            _let(F.coalesce(window_hashes(F.col("w"), WINDOW), F.expr("cast(array() as array<bigint>)")), _covered).cast("long").alias("n_repeat_words"),
        ).alias("c"),
    ).select("doc_id", "c.*")
    counted = counted.select("*", F.col("lines.all").alias("n_lines"), (F.col("lines.all") - F.col("lines.new")).cast("long").alias("n_dup_lines"))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    passed = F.lit(True)
    for _, ratio, least, most in RULES:
        value = F.expr(ratio)
        if least is not None:
            passed &= F.coalesce(value >= least, F.lit(True))
        if most is not None:
            passed &= F.coalesce(value <= most, F.lit(True))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"))


def _rules_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    passed = " and ".join(f"coalesce({ratio} {sign} {bound}, true)" for _, ratio, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
    spaces = r"[\x20\x09-\x0D]"
    return rf"""
with texts as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
rowed as (select *, row_number() over () as r from texts),
windows as (
  select r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as h
  from (select r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) as i from rowed where len(w) >= {WINDOW}) x),
twice as (select r, i from (select r, i, count(*) over (partition by r, h) as n from windows) x where n > 1),
steps as (select r, least({WINDOW}, coalesce(lead(i) over (partition by r order by i) - i, {WINDOW})) as n from twice),
repeated as (select r, cast(sum(n) as bigint) as n from steps group by r),
lines as (
  select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup
  from (select r, unnest(string_split(t, chr(10))) as x from rowed) y where regexp_matches(x, '{WORD}') group by r),
counted as (
  select a.doc_id, cast(len(a.w) as bigint) as n_words,
         cast(length(regexp_replace(a.t, '{spaces}', '', 'g')) as bigint) as word_chars,
         cast(length(a.t) - length(regexp_replace(a.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         length(a.t) - length(regexp_replace(a.t, '[A-Z]', '', 'g')) as n_upper,
         len([x for x in a.w if lower(x) in ({stop})]) as n_stop,
         cast(coalesce(l.n_dup, 0) as bigint) as n_dup_lines, coalesce(l.n_lines, 0) as n_lines,
         coalesce(p.n, 0) as n_repeat_words
  from rowed a left join lines l using (r) left join repeated p using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {passed} as passed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and passed as kept
from judged
"""


#: The same rows in DuckDB's SQL.
RULES_SQL = _rules_sql()
