"""Secret scan with multipart credential linking.

Strong patterns (assignments, access keys, long hex) are reported wherever they stand. Weak candidates (short or
temporary access identifiers, account names, bare high-entropy strings, service endpoints) are intervals that are
joined within a scope, a paragraph: identifiers, endpoints and access keys on one side, secrets and other strong
spans on the other. Only weak candidates whose scope holds a part of the other side are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import arrow_column

#: Kinds in the order in which they are listed where spans start together.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""\b(?:A[KS]IA[A-Z0-9]{8,}|AIza[A-Za-z0-9_-]{20,}|(?:user(?:name)?|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,})""", re.A)
_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_TOUCHES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_URL = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.A)
_SERVICE = re.compile(r"\.(?:amazonaws|windows|googleapis)\.(?:com|net)\b", re.A)
_HOST_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
_SCOPE = re.compile(r"\n[\x20\t]*\n")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The strong patterns, leftmost and non-overlapping within each kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _looks_random(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 12


def _endpoints(text: str) -> list[Span]:
    """Addresses with a scheme, and hosts of known services; a host is read backwards from its suffix, so that the time is linear."""
    urls = [(m.start(), m.end(), "endpoint") for m in _URL.finditer(text)] if "://" in text else []
    out: list[Span] = []
    last = 0
    for m in _SERVICE.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _HOST_CHARACTERS:
            a -= 1
        joined = out and a == last
        while a < m.start() and text[a] in ".-":  # a host starts with a letter or digit
            a += 1
        if joined:
            out[-1] = (out[-1][0], m.end(), "endpoint")
        elif a < m.start():
            out.append((a, m.end(), "endpoint"))
        last = m.end()
    return urls + _apart(out, urls)


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none of ``taken``: no span that begins before their end ends after their beginning."""
    taken = sorted(taken)
    begins, reach = [t[0] for t in taken], list(accumulate((t[1] for t in taken), max))
    return [s for s in spans if not (i := bisect_left(begins, s[1])) or reach[i - 1] <= s[0]]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates with a complementary part in the same scope; none overlaps a base span, nor a secret another candidate."""
    named = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)] if "IA" in text or "AIza" in text or "=" in text or ":" in text else []
    near = _apart(named, base)
    near += _apart(_endpoints(text), [*base, *near])
    if not near and not any(s[2] == "access" for s in base):
        return []
    bare = [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if _looks_random(m[0])]
    bare = [s for s in bare if (not s[0] or text[s[0] - 1] not in _TOUCHES) and (s[1] == len(text) or text[s[1]] not in _TOUCHES)]
    bare = _apart(bare, [*base, *near])
    scopes = [m.start() for m in _SCOPE.finditer(text)]
    scope = lambda s: bisect_right(scopes, s[0])
    asks = {scope(s) for s in [*near, *base] if s[2] in ("identifier", "endpoint", "access")}
    answers = {scope(s) for s in [*bare, *base] if s[2] in ("secret", "assign", "hex")}
    return sorted([s for s in near if scope(s) in answers] + [s for s in bare if scope(s) in asks])


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


_EMPTY = hashlib.sha256(b"").hexdigest()


def _scan(texts: pa.Array) -> pa.Array:
    rows: list[tuple] = []
    for text in texts:
        text = text.as_py()
        if text is None:
            rows.append((0, 0, 0, _EMPTY, ""))
            continue
        base = base_spans(text)
        listed = _digest(base)
        more = linked_spans(text, base)
        n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
        rows.append((*n, hashlib.sha256(listed.encode()).hexdigest(), _digest(base + more) if more else listed))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, counts and SHA-256 of the strong spans, and all spans.

    A span is ``kind:start:end`` in code points, end exclusive. A secret alone, or an identifier alone in its paragraph,
    is no span. Null texts count as empty: no spans, the hash of the empty string. Repeated rows get equal results;
    ``doc_id`` may have any type; an empty table gives an empty one; extra columns are not read. A text is held once,
    whatever its length, and read in linear time; nothing is shuffled.
    """
    found = arrow_column(docs.sparkSession, _scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", F.col("text"))
    return docs.select("doc_id", found.alias("x")).select("doc_id", "x.*")
