import decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import hashing, money, python
from quire.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert sorted(one(spark, tx.terms(F.col("t")), t="abca")) == ["a", "ab", "abc", "b", "bc", "bca", "c", "ca"]
    assert sorted(one(spark, tx.terms(F.col("t")), t="𠮷A")) == ["a", "𠮷", "𠮷a"]
    assert one(spark, tx.terms(F.col("t")), t="") == []


@pytest.mark.parametrize("raw, flat", [("「 第一章 」", "第一章"), ("((a b))", "ab"), ("(a)(b)", "a)(b"), ("", "")])
def test_edge_text(spark, raw, flat):
    assert one(spark, tx.edge_text(F.col("t")), t=raw) == flat


def test_unique_place(spark):
    place = tx.unique_place(F.col("t"), F.col("q"))
    assert [one(spark, place, t=t, q=q) for t, q in (("甲之乙", "之"), ("之乎之", "之"), ("甲", "乙"), ("甲", ""))] == [1, None, None, None]


def test_substituted(spark):
    spans = F.expr("array(named_struct('start', 4, 'end', 5, 'value', 'Y'), named_struct('start', 1, 'end', 3, 'value', 'XX'), named_struct('start', 2, 'end', 4, 'value', 'lost'), named_struct('start', 9, 'end', 99, 'value', 'lost'))")
    assert one(spark, tx.substituted(F.col("t"), spans), t="abcdef") == "aXXdYf"


def test_markup_and_fences(spark):
    assert one(spark, tx.markup_text(F.col("t")), t="<table><tr><td>a</td><td>b &amp;lt;</td></tr><tr><td>c</td></tr></table>") == "a\tb &lt;\nc"
    assert one(spark, tx.unfenced(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, tx.unfenced(F.col("t")), t="```\nx\n``` more") is None
    assert one(spark, tx.html_escape(F.col("t")), t="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, tx.safe_filename(F.col("t")), t=" a/b\x01 ") == "a_b_"
    assert one(spark, tx.reflow(F.col("t")), t="one\ntwo\n三\n四") == "one two\n三四"


def box(x, y, w, h):
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)))


def test_geometry(spark):
    assert one(spark, geo.valid(box(0.1, 0.2, 0.3, 0.4))) is True
    assert one(spark, geo.valid(box(0.9, 0.2, 0.3, 0.4))) is False
    assert one(spark, geo.iou(box(0, 0, 0.2, 0.2), box(0.1, 0, 0.2, 0.2))) == pytest.approx(1 / 3)
    assert one(spark, geo.position_bucket(F.lit(-0.075))) == -2
    assert [one(spark, geo.edge_zone(b)) for b in (box(0, 0.02, 1, 0.04), box(0, 0.95, 1, 0.03), box(0, 0.5, 1, 0.03))] == ["TOP", "BOTTOM", None]
    tiles = one(spark, geo.tiles("quadrants"))
    assert len(tiles) == 4 and tiles[3]["region"]["x"] == pytest.approx(0.475) and sum(t["core"]["w"] * t["core"]["h"] for t in tiles) == pytest.approx(1)


def test_money(spark):
    fee = lambda p, i, o, a, b: one(spark, money.fee(*(F.lit(v).cast("decimal(20,6)") if v is not None else F.lit(None).cast("decimal(20,6)") for v in (p, i, o)), *(F.lit(v).cast("long") for v in (a, b))))
    assert fee("0.2", 2, 4, None, None) == decimal.Decimal("0.2")
    assert fee(None, 2, 4, 1_000_000, 500_000) == decimal.Decimal(4)
    assert fee(None, 2, 4, None, 5) is None
    assert one(spark, money.saturating_add(F.lit(2**63 - 1), F.lit(1).cast("long"))) == 2**63 - 1


def test_hashing(spark):
    import hashlib
    import uuid

    h = ""
    for seq, name in ((1, "a"), (2, "b")):
        h = hashlib.sha256(f"{h}:{seq}:{name}".encode()).hexdigest()
    log = F.expr("array(named_struct('seq', 2, 'id', 'b'), named_struct('seq', 1, 'id', 'a'))")
    assert one(spark, hashing.chain(log)) == h
    assert one(spark, hashing.identity(F.lit("a"), F.lit(None).cast("string"))) != one(spark, hashing.identity(F.lit("a"), F.lit("")))
    raw = bytearray(hashlib.md5(b"issue-1").digest())
    raw[6], raw[8] = raw[6] & 0x0F | 0x30, raw[8] & 0x3F | 0x80
    assert one(spark, hashing.name_uuid(F.lit("issue-1"))) == str(uuid.UUID(bytes=bytes(raw)))


@pytest.mark.parametrize(
    "text, quote, n, before, after, want",
    [
        ("之乎者也之乎", "之乎", 1, None, None, ("OK", 4, 6)), ("甲之乙丙之丁", "之", None, "甲", "乙", ("OK", 1, 2)),
        ("之乎者也之乎", "之", None, None, None, ("LOCATION_AMBIGUOUS", None, None)), ("之乎", "之", 5, None, None, ("BAD_OCCURRENCE", None, None)),
        ("甲之乙", "之", None, "丙", None, ("CONTEXT_MISMATCH", None, None)), ("甲乙", "丙", None, None, None, ("UNALIGNED", None, None)),
    ],
)
def test_located(spark, text, quote, n, before, after, want):
    df = spark.createDataFrame([(text, quote, n, before, after)], "t string, q string, n int, b string, a string")
    assert tuple(df.select(python.located("t", "q", "n", "b", "a").alias("x")).first()["x"]) == want


def test_python_functions(spark):
    df = spark.createDataFrame([("𠮷a", 3, '{"b":1,"a":[2]}', "ﾊﾝ"), (None, 1, '{"a":1,"a":2}', None)], "t string, u int, j string, w string")
    rows = df.select(python.code_point_offset("t", "u").alias("o"), python.canonical_json("j").alias("j"), python.nfkc("w").alias("w"), python.indel_share("t", "w").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(2, '{"a":[2],"b":1}', "ハン", 1.0), (None, None, None, None)]
    assert [s["op"] for s in spark.createDataFrame([("abc", "axc")], "a string, b string").select(python.edit_steps("a", "b").alias("x")).first()["x"]] == ["replace"]
