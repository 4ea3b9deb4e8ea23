import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, gates, ledger, search, sequence
from quire.schema import PAGE
from quire.sources import pages
from quire.streaming import reducers


def block(i, text, kind="text", y=0.4, h=0.04, level=None, **more):
    base = dict(id=f"b{i}", type=kind, order=i, bbox=(0.1, y, 0.5, h), writing_mode="vertical-rl", original=text, simplified=None, confidence=0.9, uncertain=False, reviewed=False, heading_level=level, source="x", source_ids=["s"], suggestion=None, issues=[])
    return tuple((base | more).values())


@pytest.fixture(scope="module")
def book(spark):
    rows = [("b", n, 600.0, 800.0, "READY", 1, [block(0, "易學大全", "heading", y=0.02)] + ([block(1, "第一章 星曜" if n == 3 else "第二章 宮垣", "heading")] if n in (3, 7) else [])) for n in range(1, 11)]
    return spark.createDataFrame(rows, PAGE)


def test_running_header_stays_out_of_outline(spark, book):
    groups = blocks.layout_groups(book)
    rows = blocks.exploded(book).join(groups, ["book_id", "page_number"])
    from quire.functions import geometry as geo
    from quire.functions.text import edge_text

    edges = rows.select("book_id", "layout_group", geo.edge_zone(F.col("block.bbox")).alias("zone"), geo.position_bucket(F.col("block.bbox.y")).alias("bucket"), edge_text(F.col("block.original")).alias("text"), "page_number").where("zone is not null")
    observed = groups.groupBy("book_id", "layout_group").agg(F.count("*").alias("pages"))
    clusters = blocks.edge_clusters(edges, observed)
    assert {r["page_count"] for r in clusters.collect()} == {5}
    none = spark.createDataFrame([], "book_id string, page_number int, id string, action string")
    out = blocks.presented(rows.select("book_id", "page_number", "layout_group", "block"), clusters, none, spark.createDataFrame([("b", "書名")], "book_id string, title string")).collect()
    assert {(r["page_number"], r["text"]) for r in out if r["in_outline"]} == {(3, "第一章 星曜"), (7, "第二章 宮垣")}
    assert {r["page_number"] for r in out if r["role"] == "RUNNING_HEADER" and r["show"]} == {1, 2}


def test_violations(spark):
    bad = [block(0, "a"), block(0, "b", kind="poem", confidence=1.5, bbox=(0.9, 0.1, 0.3, 0.1)), block(2, "ok")]
    got = blocks.violations(blocks.exploded(spark.createDataFrame([("b", 1, 1.0, 1.0, "READY", 1, bad)], PAGE))).collect()
    assert sorted(sum((r["reasons"] for r in got), [])) == ["BBOX", "CONFIDENCE", "DUPLICATE_ID", "DUPLICATE_ID", "DUPLICATE_ORDER", "DUPLICATE_ORDER", "TYPE"]


@pytest.mark.parametrize("text, y, ad", [("更多低價資料 微 信：demo user123", 0.005, True), ("购买资料加微信 abc123", 0.93, True), ("微信 abc12345", 0.93, False), ("购买资料加微信 abc123。", 0.93, False), ("购买资料加微信 abc123", 0.5, False)])
def test_margin_ads(spark, text, y, ad):
    page = spark.createDataFrame([("b", 1, 1.0, 1.0, "READY", 1, [block(0, text, y=y, h=0.035)])], PAGE)
    assert blocks.exploded(page).select(blocks.is_margin_ad(F.col("block"), F.col("block.original"))).first()[0] is ad


def test_matrix_and_contents(spark):
    df = spark.createDataFrame([("\n".join(["凶", "吉"] * 50),), ("\n".join(f"line {i}" for i in range(100)),), ("一 ......... 3\n二 ......... 9\n三 ......... 12",)], "t string")
    assert [tuple(r) for r in df.select(blocks.is_matrix(F.col("t")), blocks.is_toc_entry(F.col("t"))).collect()] == [(True, False), (False, False), (False, True)]


def test_page_ranges():
    assert pages.page_ranges("1-3,2,5", 5) == [(1, 3), (2, 2), (5, 5)] and pages.page_ranges("all", 3) == [(1, 3)]
    for bad in ("0,2", "3-1", "4"):
        with pytest.raises(ValueError):
            pages.page_ranges(bad, 3)


def test_parsed_blocks(spark):
    raw = [("b", 1, 100.0, 200.0, '{"layouts":[{"id":"x","text":"一","type":"title","x":10,"y":20,"w":10,"h":100},{"id":"x","text":"二","type":"odd","x":0,"y":0,"w":200,"h":10},{"id":"z","text":" ","type":"text","x":0,"y":0,"w":1,"h":1}]}')]
    got = pages.parsed(spark.createDataFrame(raw, "book_id string, page_number int, width double, height double, json string")).orderBy("order").collect()
    assert [(r["id"], r["type"], r["writing_mode"]) for r in got] == [("x", "heading", "vertical-rl"), ("x-2", "text", "horizontal-tb")] and got[1]["bbox"]["w"] == 1.0


def test_revisions(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, r) for r in range(12)], "book_id string, page_number int, revision int")
    pages.append_revision(rows, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert [r["revision"] for r in pages.current(table).collect()] == [11]
    assert sorted(r["revision"] for r in pages.history(table).collect()) == [6, 7, 8, 9, 10]


def test_segments(spark, tmp_path):
    good = pages.MAGIC + pages.frame(b"one") + pages.frame(b"two")
    (tmp_path / "a").write_bytes(good + pages.frame(b"three")[:-2])
    broken = bytearray(good)
    broken[-1] ^= 1
    (tmp_path / "b").write_bytes(bytes(broken))
    got = pages.read_segments(spark, str(tmp_path)).orderBy("path", "frame").collect()
    assert [(r["frame"], r["state"]) for r in got] == [(0, "OK"), (1, "OK"), (2, "TORN"), (0, "OK"), (1, "CORRUPT")]


def test_paging_is_stable(spark):
    log = spark.range(15).select(F.col("id").alias("seq"))
    pinned, cursor, sizes = search.frozen(log, "seq", 4), None, []
    while rows := search.after(pinned, ["seq"], cursor, 2).collect():
        sizes.append(len(rows))
        cursor = [rows[-1]["seq"]]
    assert sizes == [2, 2, 1]


def test_search_with_and_without_index(spark):
    docs = spark.createDataFrame([("s", i, f"第{i}页文本内容\n\nAbC") for i in range(20)], "source string, doc_id long, text string")
    lines = search.lines(docs)
    for q in ("文本", "bc", "a", "页文本内"):
        assert search.search(lines, q, 100).collect() == search.search(lines, q, 100, search.postings(lines)).collect() != []


def test_budget_and_progress(spark):
    kinds = [False, False, False, True, False, False, True, True, True, False]  # refunds
    claims = spark.createDataFrame([("a", i, r) for i, r in enumerate(kinds)] + [("b", 0, True)], "b string, i int, refund boolean")
    got = ledger.granted(claims, "b", "i", 2).orderBy("b", "i").collect()
    assert [(r["remaining"], r["granted"]) for r in got] == [(1, True), (0, True), (0, False), (1, True), (0, True), (0, False), (1, True), (2, True), (2, False), (1, True), (2, False)]
    n = lambda *v: tuple(F.lit(x) for x in v)
    percent = lambda done, end=False: spark.range(1).select(ledger.percent(done, F.lit(end))).first()[0]
    start = {"OCR": n(1, 1), "STRUCTURE": n(1, 1)}
    assert [percent(start), percent(start | {"REVIEW": n(5, 10)}), percent(start | {"REVIEW": n(10, 10)}), percent(start, True)] == [50, 67, 85, 100]


def test_usage(spark):
    calls = [("A", "SUCCEEDED", 5, 1), ("A", "CACHE_REUSED", None, None), ("A", "FAILED", None, None), ("A", "SUCCEEDED", 7, 1), ("B", "SENT_UNKNOWN", None, None)]
    got = ledger.usage(spark.createDataFrame(calls, "book string, status string, tokens_in long, amount long"), ["book"]).orderBy("book").collect()
    assert [(r["requests"], r["cache_hits"], r["succeeded"], r["failed"], r["pending"], r["unknown_in"]) for r in got] == [(3, 1, 2, 1, 0, 1), (1, 0, 0, 0, 1, 1)]


def test_metrics_and_gates(spark):
    cases = [("不得", "不得", True), ("未得", "不得", True), ("甲", None, False), (None, None, False)]
    row = gates.metrics(spark.createDataFrame(cases, "truth string, picked string, offered boolean"), []).first()
    assert (row["cases"], row["recall"], row["accuracy"]) == (3, 0.666667, 0.5)
    risk = spark.createDataFrame([("不得", "得"), ("三尺", "五尺"), ("a", "b")], "a string, b string").select(gates.risks(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in risk] == [["NEGATION"], ["NUMERIC", "UNIT"], []]
    used = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(map(tuple, gates.coverage(spark.createDataFrame([(1,), (2,), (3,)], "k int"), used, "k").collect())) == [(1, 2), (3, 0)]


def test_packing(spark):
    df = spark.createDataFrame([(d, i, "x" * 100) for d in (1, 2) for i in range(20)], "doc_id long, block_no int, text string")
    got = sequence.packed(df, "doc_id", 12, 900).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["first_block"], r["last_block"]) for r in got] == [(d, a, b) for d in (1, 2) for a, b in ((0, 8), (9, 17), (18, 19))]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    latest = drained(reducers.latest_state(source()), "complete", "latest")
    want = ledger.latest(events, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
    counts = drained(reducers.counters(source()), "complete", "counts")
    assert sum(r["n"] for r in counts.collect()) == events.count()
    seen = drained(reducers.progress(source().select("user_id", F.col("event_id").alias("seq"))), "update", "progress")
    top = seen.groupBy("user_id").agg(F.max("high").alias("high"))
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, events.groupBy("user_id").agg(F.max("event_id")).collect()))
