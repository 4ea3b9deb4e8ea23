"""The functions that no built-in expresses, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("a0", "a1", "b0", "b1")]])
_PLACE = T.StructType([T.StructField("code", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Keys sorted, no spaces; null where the text is no JSON or repeats a key."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def one(t: str) -> str | None:
        try:
            return json.dumps(json.loads(t, object_pairs_hook=pairs), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(_STEP))
def edit_steps(a: pd.Series, b: pd.Series) -> pd.Series:
    """What turns ``a`` into ``b``, in code points, without the equal stretches."""

    def one(x: str | None, y: str | None) -> list | None:
        if x is None or y is None:
            return None
        return [dict(op=o, a0=i, a1=j, b0=k, b1=m) for o, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o != "equal"]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def indel_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insertions and deletions (a substitution is both) per code point of the two texts; 0 for two empty ones."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last if c == d else min(row[j], row[j - 1]) + 1
        return row[-1] / max(len(x) + len(y), 1)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_PLACE)
def located(text: pd.Series, quote: pd.Series, occurrence: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Place of a quote: its given occurrence, or the one whose context fits; a code says why there is none."""

    def one(t, q, n, b, a) -> tuple:
        if not t or not q:
            return ("UNALIGNED", None, None)
        at, found = t.find(q), []
        while at >= 0:
            found.append(at)
            at = t.find(q, at + len(q))
        if not found:
            return ("UNALIGNED", None, None)
        if n is not None and n == n:
            if not 0 <= int(n) < len(found):
                return ("BAD_OCCURRENCE", None, None)
            found = [found[int(n)]]
        found = [s for s in found if t[:s].endswith(b or "") and t[s + len(q) :].startswith(a or "")]
        if len(found) != 1:
            return ("LOCATION_AMBIGUOUS" if found else "CONTEXT_MISMATCH", None, None)
        return ("OK", found[0], found[0] + len(q))

    clean = lambda s: [None if v is None or v != v else v for v in s]
    return pd.DataFrame([one(*row) for row in zip(*map(clean, (text, quote, occurrence, before, after)), strict=True)], columns=["code", "start", "end"]).astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(T.IntegerType())
def code_point_offset(text: pd.Series, units: pd.Series) -> pd.Series:
    """A UTF-16 offset as one in code points; null where it is outside the text or splits a pair."""

    def one(t: str | None, n) -> int | None:
        if t is None or n is None or n != n or n < 0:
            return None
        raw = t.encode("utf-16-le", "surrogatepass")
        try:
            return len(raw[: 2 * int(n)].decode("utf-16-le")) if 2 * n <= len(raw) else None
        except UnicodeDecodeError:
            return None

    return pd.Series([one(t, n) for t, n in zip(text, units, strict=True)], dtype="Int32")
