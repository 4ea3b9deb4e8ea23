"""Inverted n-gram index and exact substring search with paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import anchor, contains_folded, terms


def lines(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, block_no, text)``: the lines with a character other than a space, numbered from 0."""
    split = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_no", "text"))
    return split.where(F.length(F.trim("text")) > 0)


def postings(blocks: DataFrame, longest: int = 3) -> DataFrame:
    """``(gram, doc_id, block_no)``, distinct. Meant to be written out, partitioned or bucketed by ``gram``."""
    return blocks.select(F.explode(terms(F.col("text"), longest)).alias("gram"), "doc_id", "block_no")


def search(blocks: DataFrame, query: str, limit: int, index: DataFrame | None = None) -> DataFrame:
    """Blocks that contain ``query``, case folded, in the order of document and block, ``limit`` at most.

    With an index the anchor's postings are read first; the containment itself is always verified.
    """
    if index is not None:
        probe = index.where(F.col("gram") == anchor(query)).select("doc_id", "block_no")
        blocks = blocks.join(probe, ["doc_id", "block_no"], "left_semi").select(*blocks.columns)
    return blocks.where(contains_folded(F.col("text"), query)).orderBy("doc_id", "block_no").limit(limit)


def after(df: DataFrame, keys: list[str], cursor: list | None, limit: int) -> DataFrame:
    """The next page in the order of ``keys``: rows beyond the cursor, which is the last row's keys."""
    if cursor is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for k, v in zip(keys, cursor, strict=True):
            beyond, equal = beyond | (equal & (F.col(k) > F.lit(v))), equal & (F.col(k) == F.lit(v))
        df = df.where(beyond)
    return df.orderBy(*keys).limit(limit)


def frozen(log: DataFrame, seq: str, through: int) -> DataFrame:
    """The log as a reader pinned at ``through`` sees it, however much is appended later."""
    return log.where(F.col(seq) <= through)


def cursor_text(*keys: Column) -> Column:
    return F.base64(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary"))
