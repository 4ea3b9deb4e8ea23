"""The book index and the export on disk: postings in term partitions, summaries and pages in shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import anchor, script_safe_json
from quire.operators.search import postings, search

#: Pages of a shard, term partitions, and search rows of a book's export. Fixed values.
SHARD, PARTS, SEARCH_ROWS = 128, 256, 20_000
#: Files that a partition is written to, so that a frequent term or a large shard is no single task.
SPREAD = 8


def term_part(gram: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def shard_of(page: Column, size: int = SHARD) -> Column:
    return F.floor((page - 1) / size).cast("int")


def _written(rows: DataFrame, part: str, spread: list[str], order: list[str], path: str) -> None:
    cut = rows.repartition(part, F.pmod(F.xxhash64(*spread), F.lit(SPREAD)))
    cut.sortWithinPartitions(part, *order).write.mode("overwrite").partitionBy(part).parquet(path)


def write_index(blocks: DataFrame, summaries: DataFrame, path: str) -> None:
    """``blocks(doc_id, block_no, text)`` as postings and ``summaries(book_id, page_number, ..)`` as shards under ``path``."""
    _written(postings(blocks).withColumn("part", term_part(F.col("gram"))), "part", ["doc_id", "block_no"], ["gram", "doc_id", "block_no"], f"{path}/postings")
    _written(summaries.withColumn("shard", shard_of(F.col("page_number"))), "shard", ["book_id"], ["book_id", "page_number"], f"{path}/summaries")


def read_summaries(spark: SparkSession, path: str, book: str, first: int, last: int) -> DataFrame:
    """Summaries of pages ``first`` to ``last`` of a book; only their shards are read."""
    shards = F.col("shard").between((first - 1) // SHARD, (last - 1) // SHARD)
    return spark.read.parquet(f"{path}/summaries").where(shards & (F.col("book_id") == book) & F.col("page_number").between(first, last)).drop("shard").orderBy("page_number")


def find(spark: SparkSession, path: str, blocks: DataFrame, query: str, limit: int) -> DataFrame:
    """Exact search through the one term partition that holds the anchor of ``query``."""
    index = spark.read.parquet(f"{path}/postings").where(F.col("part") == term_part(F.lit(anchor(query))))
    return search(blocks, query, limit, index)


def write_export(pages: DataFrame, outline: DataFrame, lines: DataFrame, path: str, most: int = SEARCH_ROWS) -> None:
    """Pages, outline, search rows and the page map of books as JSON lines.

    ``pages(book_id, page_number, payload)``, the payload made safe for scripts; ``outline(book_id, page_number, ..)``;
    ``lines(book_id, page_number, order, text)``, the first ``most`` of a book, as the export's search is limited.
    """
    paged = pages.withColumn("shard", shard_of(F.col("page_number"))).withColumn("payload", script_safe_json(F.col("payload")))
    spread = F.pmod(F.xxhash64("book_id"), F.lit(SPREAD))
    paged.repartition("shard", spread).sortWithinPartitions("shard", "book_id", "page_number").write.mode("overwrite").partitionBy("shard").json(f"{path}/pages")
    paged.select("book_id", "page_number", "shard").write.mode("overwrite").json(f"{path}/page_map")
    outline.write.mode("overwrite").json(f"{path}/outline")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("page_number", "order"))
    lines.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank").write.mode("overwrite").json(f"{path}/search")
