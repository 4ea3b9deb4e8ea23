"""Text functions over columns. Offsets are code points; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A line that opens a chapter or a section, in Chinese or English books. Fixed value.
CHAPTER = r"^\s*(第[0-9一二三四五六七八九十百千〇零]+[章回卷篇節节]|(?i:chapter|part)\s+[0-9IVXLC]+)"
#: Traditional characters and the simplified ones in their places: a small map; the whole dictionary is a parameter.
TRADITIONAL, SIMPLIFIED = "曆時實書長國學門開東車馬語說為", "历时实书长国学门开东车马语说为"


def terms(text: Column, longest: int = 3) -> Column:
    """All distinct grams of 1 to ``longest`` code points of the lower-cased text."""
    low = F.lower(text)

    def grams(x: Column) -> Column:
        n = F.size(x)
        none = F.expr("cast(array() as array<string>)")

        def of(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat(*[F.get(x, i + j) for j in range(k)]))).otherwise(none)

        return F.array_distinct(F.concat(*[of(k) for k in range(1, longest + 1)]))

    # code points once as an array: places in a string are found by counting from its start
    return F.transform(F.array(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0))), grams)[0]


def anchor(query: str, longest: int = 3) -> str:
    return query.lower()[:longest]


def contains_folded(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def edge_text(text: Column, peels: int = 4) -> Column:
    """Without white space and without outer brackets, up to ``peels`` pairs."""
    out = F.regexp_replace(text, r"\s+", "")
    for _ in range(peels):
        out = F.regexp_replace(out, r"^(?:\((.*)\)|\[(.*)\]|（(.*)）|【(.*)】|《(.*)》|「(.*)」)$", "$1$2$3$4$5$6")
    return out


def display_text(simplified: Column, original: Column) -> Column:
    return F.when(F.length(F.trim(simplified)) > 0, simplified).otherwise(original)


def to_simplified(text: Column, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> Column:
    """Character by character, so offsets stay; phrases need a dictionary and are not attempted."""
    return F.translate(text, traditional, simplified)


def clip(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def unique_place(scope: Column, quote: Column) -> Column:
    """0-based place of ``quote`` if it occurs exactly once in ``scope``, else null."""
    at = F.position(quote, scope)
    again = F.position(quote, scope, at + 1)
    return F.when((F.length(quote) > 0) & (at > 0) & (again == 0), at - 1)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def script_safe_json(text: Column, unsafe: str = "<>&\u2028\u2029") -> Column:
    """The characters of ``unsafe`` as ``\\u`` and four digits, by default those that could end a script or a line of one."""
    for raw in unsafe:
        text = F.replace(text, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    return text


def safe_filename(name: Column, longest: int = 120, reserved: str = r'\\/:*?"<>|') -> Column:
    """Control characters and ``reserved`` ones (of a character class) become ``_``; blank names are null."""
    out = F.left(F.trim(F.regexp_replace(name, rf"[\p{{Cntrl}}{reserved}]", "_")), F.lit(longest))
    return F.when(F.length(out) > 0, out)


def markup_text(html: Column) -> Column:
    """Tables and simple markup as plain text: rows on lines, cells apart by tabs, five entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)</t[dh]>\s*(?=<t[dh])", "\t")
    out = F.regexp_replace(out, r"(?i)</(tr|p|div|h[1-6]|li)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(safe), F.lit(raw))
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def reflow(text: Column) -> Column:
    """Soft line breaks joined: by a space between Latin letters or digits, by nothing between others."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Za-z0-9,;])[ \t]*\n[ \t]*(?=[A-Za-z0-9])", " "), r"(?<=[^\x00-\x7F\n])\n(?=[^\x00-\x7F\n])", "")


def unfenced(text: Column) -> Column:
    """The body of one complete code fence, the text itself if it has none, null where text follows the fence."""
    body = F.regexp_extract(text, r"(?s)^\s*```[a-z]*\n(.*?)\n?```\s*$", 1)
    return F.when(~F.trim(text).startswith("```"), text).when(text.rlike(r"(?s)^\s*```[a-z]*\n.*?```\s*$"), body)


def substituted(text: Column, spans: Column) -> Column:
    """``text`` with ``spans(start, end, value)`` put in from left to right; overlapping and null-valued spans are left out."""

    def step(acc: Column, s: Column) -> Column:
        fits = (s["start"] >= acc["at"]) & (s["end"] >= s["start"]) & (s["end"] <= F.length(text)) & s["value"].isNotNull()
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(fits, F.struct(F.concat(acc["out"], gap, s["value"]).alias("out"), s["end"].cast("int").alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
