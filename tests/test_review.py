import datetime
import random

from pyspark.sql import functions as F

from quire.operators import review

BOX = "struct<x:double,y:double,w:double,h:double>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sources_and_gate(spark):
    sources = spark.createDataFrame([(1, "a", 0, "甲"), (1, "b", 1, "乙"), (1, "c", 2, "丙")], "page long, source_id string, order int, text string")
    good = spark.createDataFrame([(1, "x", ["b", "a"], "甲乙"), (1, "y", ["c"], "丙")], "page long, id string, source_ids array<string>, text string")
    assert review.merge_gate(good, sources).count() == 0 and review.unreferenced(good, sources).count() == 0
    bad = spark.createDataFrame([(1, "x", ["a", "a", "z"], "甲"), (1, "y", ["c"], "丁")], good.schema)
    assert rows(review.merge_gate(bad, sources)) == [(1, "LOST"), (1, "REPEATED"), (1, "TEXT"), (1, "UNKNOWN")]
    assert [r["source_id"] for r in review.unreferenced(bad, sources).collect()] == ["b"]


def test_boxes(spark):
    data = [(1, "f", "figure", (0.0, 0.0, 0.5, 0.5)), (1, "g", "figure", (0.0, 0.0, 0.9, 0.9)), (1, "t", "text", (0.1, 0.1, 0.1, 0.1)), (1, "u", "text", (0.95, 0.95, 0.04, 0.04))]
    assert rows(review.labels_in_figures(spark.createDataFrame(data, f"page long, id string, type string, bbox {BOX}"))) == [(1, "t", "f")]
    flat = spark.createDataFrame([(1, "a", 0.1, 0.1, 0.1, 0.1), (1, "b", 0.22, 0.11, 0.1, 0.1), (1, "c", 0.35, 0.12, 0.1, 0.1), (1, "d", 0.9, 0.5, 0.05, 0.1)], "page long, id string, x double, y double, w double, h double")
    assert rows(review.columns_merged(flat)) == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "d", "d")]
    a = spark.createDataFrame([(1, 0, "a", (0.0, 0.0, 0.2, 0.2))], f"page long, order int, id string, bbox {BOX}")
    b = spark.createDataFrame([(1, 0, "p", (0.0, 0.0, 0.2, 0.19)), (1, 0, "q", (0.0, 0.0, 0.2, 0.2)), (1, 1, "r", (0.0, 0.0, 0.2, 0.2))], a.schema)
    assert [(r["id"], r["other"]) for r in review.paired(a, b).collect()] == [("a", "q")]


def test_shift_and_reorder(spark):
    blocks = spark.createDataFrame([(1, "g", 1, "cd", [(0, 1)]), (1, "g", 0, "ab", [(1, 2)])], "page long, group string, order int, text string, spans array<struct<start:int,end:int>>")
    r = review.shifted_spans(blocks).first()
    assert r["text"] == "abcd" and [tuple(s) for s in r["spans"]] == [(1, 2), (2, 3)]
    sources = spark.createDataFrame([(p, s, i) for p in (1, 2) for i, s in enumerate("ab")], "page long, source_id string, order int")
    new = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "a", 0), (2, "a", 1)], "page long, source_id string, position int")
    assert rows(review.reordered(new, sources)) == [(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 1)]


def test_triage_and_chain(spark):
    edits = spark.createDataFrame([("a", "h1", "x"), ("b", "h1", "x"), ("c", "h1", "x"), ("d", None, "x"), ("e", "h0", "same")], "id string, base_hash string, text string")
    now = spark.createDataFrame([("a", "h1", "o"), ("b", "h2", "o"), ("d", "h1", "o"), ("e", "h1", "same")], "id string, hash string, text string")
    assert rows(review.triage(edits, now)) == [("a", "APPLIABLE"), ("b", "CONFLICT"), ("c", "PENDING"), ("d", "INVALID"), ("e", "SAME")]
    log = spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("k", 3, 1)], "id string, seq int, base int")
    assert rows(review.revision_chain(log)) == [("k", 1, True), ("k", 2, False), ("k", 3, True)]
    assert spark.range(1).select(review.first_mismatch({"a": (F.lit(1), F.lit(1)), "b": (F.lit(1), F.lit(None).cast("int")), "c": (F.lit(1), F.lit(2))})).first()[0] == "b"


def test_small_rules(spark):
    now = F.lit(datetime.datetime(2026, 1, 1, 12, 0, 0))
    got = spark.range(1).select(review.retry_after(F.lit("7"), now), review.retry_after(F.lit("Thu, 01 Jan 2026 12:01:00 GMT"), now), review.retry_after(F.lit("9999"), now), review.retry_after(F.lit("soon"), now)).first()
    assert tuple(got) == (7, 60, 300, None)
    issues = spark.createDataFrame([("b", "1", 0, 5), ("b", "2", 3, 6), ("b", "3", 5, 7), ("b", "4", 8, 9), ("b", "5", 9, 10), ("c", "6", 0, 1)], "block string, id string, start int, end int")
    assert {r["id"] for r in review.disjoint_targets(issues).collect()} == {"1", "3", "4", "6"}
    events = spark.range(30).select(F.lit("k").alias("k"), "id")
    assert review.bounded_buffer(events, "k", "id", 20, 5).count() == 6
    assert [r["n"] for r in review.halves(spark.range(5).withColumn("g", F.lit(1)), "g", "id").groupBy("half").agg(F.count("*").alias("n")).orderBy("half").collect()] == [3, 2]
    folios = spark.createDataFrame([(1, "right", 3), (1, "left", 4), (2, "right", 3), (2, "left", 9)], "page int, side string, number int")
    assert rows(review.folio_pairs(folios)) == [(1, 3, 4)]
    glyphs = spark.createDataFrame([(1, "字")] * 20 + [(2, "字")] * 5, "page int, text string")
    assert rows(review.trusted_text(glyphs)) == [(1, True), (2, False)]
    books = spark.createDataFrame([("1", "易經", "a.pdf", False, 1), ("2", "Other", "易.pdf", None, 2), ("3", "易", "c.pdf", True, 3)], "id string, title string, filename string, archived boolean, created_at int")
    assert [r["id"] for r in review.shelf(books, "易").collect()] == ["2", "1"]


def test_columns_of_many_pages(spark):
    """Against a plain fixpoint: many pages in a batch, a page over many batches, ties, ids in another order than places."""
    rng = random.Random(3)
    data = [(p, f"b{rng.randrange(9)}{i}", rng.randrange(20) / 20, rng.randrange(9) / 20, rng.choice([0.0, 0.05, 0.1]), 0.1) for p in range(200) for i in range(rng.randrange(1, 9) if p % 50 else 60)]
    want = set()
    for page in range(200):
        boxes = [d for d in data if d[0] == page]
        head = {d[1]: d[1] for d in boxes}
        changed = True
        while changed:
            changed = False
            for a in boxes:
                for b in boxes:
                    if abs(a[3] - b[3]) <= 0.1 and b[2] >= a[2] and b[2] - (a[2] + a[4]) <= 0.04 and head[a[1]] != head[b[1]]:
                        head[a[1]] = head[b[1]] = min(head[a[1]], head[b[1]])
                        changed = True
        want |= {(page, i, h) for i, h in head.items()}
    given = spark.createDataFrame(data, "page long, id string, x double, y double, w double, h double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = review.columns_merged(given, tops=0.1)
            assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
