from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire.functions import hashing
from quire.operators import glyphs, signals
from quire.schema import BLOCK


def test_blocks_of_glyphs(spark):
    row = [("b", 1, 0.1 + 0.012 * i, 0.2 + 0.001 * (i % 2), 0.01, 0.02, c) for i, c in enumerate("ab")]
    row += [("b", 1, 0.14, 0.2, 0.01, 0.02, "c"), ("b", 1, 0.6, 0.2, 0.01, 0.02, "d"), ("b", 1, 0.1, 0.1, 0.01, 0.02, "甲"), ("b", 1, 0.13, 0.1, 0.01, 0.02, "乙"), ("b", 2, 0.1, 0.1, 0.01, 0.02, " ")]
    got = glyphs.blocks(spark.createDataFrame(row, glyphs.GLYPHS)).orderBy("page_number", "order").collect()
    assert [(r["page_number"], r["order"], r["text"]) for r in got] == [(1, 0, "甲乙"), (1, 1, "ab c"), (1, 2, "d")]
    assert abs(got[1]["bbox"]["x"] - 0.1) < 1e-9 and abs(got[1]["bbox"]["w"] - 0.05) < 1e-9
    columns = [("b", 1, x, y, 0.02, 0.02, c) for x, y, c in ((0.5, 0.1, "甲"), (0.501, 0.12, "乙"), (0.4, 0.1, "丙"), (0.4, 0.5, "丁"))]
    got = glyphs.blocks(spark.createDataFrame(columns, glyphs.GLYPHS), vertical=True).orderBy("order").collect()
    assert [r["text"] for r in got] == ["甲乙", "丙", "丁"]
    assert glyphs.blocks(spark.createDataFrame([], glyphs.GLYPHS)).count() == 0
    boxes = spark.createDataFrame(row, glyphs.GLYPHS).where("page_number = 1").agg(glyphs.union_box(F.struct("x", "y", "w", "h")).alias("u")).first()["u"]
    assert [round(v, 6) for v in boxes] == [0.1, 0.1, 0.51, 0.121]


def block(**given):
    given = {"type": "text", "bbox": (0.1, 0.1, 0.2, 0.2), "writing_mode": "horizontal-tb"} | given
    return tuple(given.get(f.name) for f in _parse_datatype_string(BLOCK).fields)


def test_paragraphs(spark):
    texts = ["甲乙，", "丙丁", "戊。", "，己", "庚", "注：辛", "一、壬"]
    rows = [(1, block(id=f"b{i}", order=i, original=t)) for i, t in enumerate(texts)]
    rows += [(2, block(id="r", order=0, original="右", bbox=(0.6, 0.1, 0.2, 0.2), writing_mode="vertical-rl")), (2, block(id="l", order=1, original="左", writing_mode="vertical-rl")), (2, block(id="n", order=2, original=None))]
    got = signals.paragraphs(spark.createDataFrame(rows, f"page int, block {BLOCK}")).orderBy("page", "id").collect()
    assert [(r["id"], r["paragraph"]) for r in got] == [("b0", 0), ("b1", 0), ("b2", 1), ("b3", 2), ("b4", 3), ("b5", 4), ("b6", 5), ("l", 0), ("n", 1), ("r", 0)]


def test_identities(spark):
    issue = ("i", "OCR", 0, 1, None, False, None, None)
    given = [(1, block(id="a", original="甲乙", source_ids=["s"], issues=[issue])), (2, block(id="a", original="甲丙", source_ids=["s"], issues=[issue])), (3, block(id="a", original="", source_ids=["t"], issues=[issue]))]
    df = spark.createDataFrame(given, f"n int, block {BLOCK}").orderBy("n")
    basis = [r[0] for r in df.select(hashing.issue_basis(F.col("block"), F.col("block.issues")[0])).collect()]
    assert basis[0] == basis[1] and basis[2] is None  # the quote is the same, the rest of the text is not part of it
    assert len({r[0] for r in df.select(hashing.block_source(F.col("block"))).collect()}) == 3
    same = df.select(hashing.page_content(F.col("block"), ["id", "type"])).distinct()
    assert same.count() == 1
