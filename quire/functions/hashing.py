"""Identities and hash chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(*fields: Column) -> Column:
    """SHA-256 over length-prefixed fields; null differs from empty."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def fingerprint(entries: Column) -> Column:
    """Order-independent: SHA-256 of the sorted strings."""
    return F.sha2(F.array_join(F.array_sort(entries), ";"), 256)


def chain(entries: Column, seed: str = "") -> Column:
    """Last link of h(i) = SHA-256(h(i-1) : seq : id) over structs ``seq, id``, in the order of ``seq``.

    A fold, hence one key's events in one row: meant for one segment of a log at a time.
    """
    return F.aggregate(F.array_sort(entries), F.lit(seed), lambda h, e: F.sha2(F.concat_ws(":", h, e["seq"].cast("string"), e["id"].cast("string")), 256))


def name_uuid(name: Column) -> Column:
    """The name-based UUID, version 3, of a string."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def page_content(page: Column, fields: list[str]) -> Column:
    """Identity of a page by ``fields``; commit numbers and format versions should not be among them."""
    return F.sha2(F.to_json(F.struct(*[page[f].alias(f) for f in fields]), {"ignoreNullFields": "false"}), 256)


def issue_basis(block: Column, issue: Column, version: int = 1) -> Column:
    """Identity of what a decision on an issue rests on; null where its place is not in the text."""
    text, start, end = block["original"], issue["start"], issue["end"]
    quote = F.substring(text, start + 1, end - start)
    sound = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.when(sound, identity(block["id"], issue["id"], issue["kind"], start, end, quote, issue["resolved"], issue["replacement"], F.lit(version)))


def block_source(block: Column) -> Column:
    """Identity of a block's texts and sources."""
    return identity(block["original"], block["simplified"], F.to_json(block["source_ids"]))
