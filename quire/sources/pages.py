"""Reading and writing page tables: ranges, recognised JSON, revisions, verified and frozen reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators.ledger import newest

RECOGNISED = "struct<layouts:array<struct<id:string,text:string,type:string,x:double,y:double,w:double,h:double>>>"
#: Names that recognisers give to block types, and ours. Fixed values.
KINDS = {"text": "text", "title": "heading", "paragraph_title": "heading", "doc_title": "heading", "figure": "figure", "image": "figure", "table": "table", "figure_caption": "caption", "table_caption": "caption", "formula": "formula", "number": "page-number"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_ranges(spec: str, total: int) -> list[tuple[int, int]]:
    """``all`` or ``1-20,25`` as ranges; an error if one is empty, reversed or outside 1 to ``total``."""
    if spec.strip().lower() == "all":
        return [(1, total)]
    out = []
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        a, b = int(first), int(last or first)
        if not 1 <= a <= b <= total:
            raise ValueError(f"{part.strip()} is not within 1-{total}")
        out.append((a, b))
    return out


def in_ranges(page: Column, ranges: list[tuple[int, int]]) -> Column:
    """A predicate that reaches the scan; the pages are never listed."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | page.between(a, b)
    return out


def parsed(raw: DataFrame) -> DataFrame:
    """``raw(book_id, page_number, width, height, json)`` -> one row per recognised block with text; ids made unique."""
    from quire.operators.sequence import suffixed

    rows = raw.select("book_id", "page_number", "width", "height", F.posexplode(F.from_json("json", RECOGNISED)["layouts"]).alias("order", "x"))
    rows = rows.where(F.length(F.trim("x.text")) > 0)
    box = geo.normalised(F.col("x.x"), F.col("x.y"), F.col("x.w"), F.col("x.h"), F.col("width"), F.col("height"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv]), F.col("x.type")), F.lit("text"))
    name = suffixed(F.col("x.id"), ["book_id", "page_number"], ["order"])
    return rows.select("book_id", "page_number", name.alias("id"), "order", kind.alias("type"), box.alias("bbox"), F.col("x.text").alias("original")).withColumn("writing_mode", geo.writing_mode(F.col("bbox")))


def append_revision(pages: DataFrame, path: str) -> None:
    """Adds revisions to a table that only grows; ``current`` and ``history`` are views over it."""
    pages.write.mode("append").partitionBy("book_id").parquet(path)


def current(versions: DataFrame) -> DataFrame:
    return newest(versions, ["book_id", "page_number"], "revision", 1)


def history(versions: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` revisions behind the current one."""
    return newest(versions, ["book_id", "page_number"], "revision", keep + 1).exceptAll(current(versions))


def first_original(versions: DataFrame, by: list[str], revision: str) -> DataFrame:
    rest = [c for c in versions.columns if c not in by]
    return versions.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(revision)).alias("_row")).select(*by, "_row.*")


def verified(rows: DataFrame, manifest: DataFrame, key: str, content: str) -> DataFrame:
    """``rows`` with ``intact``: whether the content has the hash that the manifest names; null if it names none."""
    return rows.join(manifest.select(key, "sha256"), key, "left").withColumn("intact", F.sha2(F.col(content), 256) == F.col("sha256"))


MAGIC = b"QLOG1\n"


def frame(payload: bytes) -> bytes:
    return len(payload).to_bytes(4, "big") + zlib.crc32(payload).to_bytes(4, "big") + payload


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Binary log segments: ``path, frame, payload, state``.

    A segment is ``MAGIC`` and frames of length, CRC-32 and payload. An incomplete last frame is reported as TORN,
    a wrong sum or magic as CORRUPT, and nothing behind it is read. One task holds one segment, which its
    writer bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = len(MAGIC), 0
                if not raw.startswith(MAGIC):
                    rows.append((name, 0, None, "CORRUPT"))
                    continue
                while at < len(raw):
                    size, crc = int.from_bytes(raw[at : at + 4], "big"), int.from_bytes(raw[at + 4 : at + 8], "big")
                    body = raw[at + 8 : at + 8 + size]
                    state = "TORN" if at + 8 > len(raw) or len(body) < size else "OK" if zlib.crc32(body) == crc else "CORRUPT"
                    rows.append((name, n, body if state == "OK" else None, state))
                    if state != "OK":
                        break
                    at, n = at + 8 + size, n + 1
            types = (pa.string(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "frame", "payload", "state"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, frame int, payload binary, state string")
