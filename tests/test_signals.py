import datetime
import time

from pyspark.sql import functions as F

from quire.operators import journal, signals
from quire.schema import BLOCK


def rows(df):
    return sorted(map(tuple, df.collect()))


def texts(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def block(**given):
    given.setdefault("bbox", (0.1, 0.1, 0.5, 0.05))
    names = [x.name for x in FIELDS]
    return tuple(given.get(n) for n in names)


def pages(spark, *values):
    return spark.createDataFrame([(i, list(v) if v is not None else None) for i, v in enumerate(values)], f"i int, blocks array<{BLOCK}>").orderBy("i")


def setup_module():
    global FIELDS
    from pyspark.sql.types import _parse_datatype_string

    FIELDS = _parse_datatype_string(BLOCK).fields


def test_kept_lines(spark):
    assert texts(spark, ["一、甲\n二、乙", "1. a\nb\nc", "prose\nprose", "", None], signals.is_numbered) == [True, False, False, False, None]
    parallel = ["四季：\n春日\n夏日\n秋日", "四季：\n春日\n夏，日\n秋日", "四季\n春日\n夏日\n秋日", "四季：", ""]
    assert texts(spark, parallel, lambda t: signals.is_parallel(t, F.lit("horizontal-tb"))) == [True, False, False, False, False]
    assert texts(spark, parallel[:1], lambda t: signals.is_parallel(t, F.lit("vertical-rl"))) == [False]
    assert texts(spark, ["甲……3\n乙……4\n丙....12", "甲……3\n乙\n丙\n丁", "甲……3\n乙……4"], signals.is_contents) == [True, False, False]
    kept = pages(spark, [block(type="figure", original="x")], [block(type="text", original="x", source="paddle-span-1")], [block(type="text", original="a\r\nb")], [block(type="text", original=None, simplified="1. a\n2. b")])
    assert [r[0] for r in kept.select(signals.keeps_lines(F.col("blocks")[0])).collect()] == [True, True, False, True]


def test_diagrams(spark):
    assert texts(spark, ["a → b\nc → d\ne → f → g", "a → b\nc\nd", "a → b → c → d → e", "a\n| | |\nb\n|||", "a\n| |\nb\n|||"], signals.is_diagram) == [True, False, False, True, False]


def test_page_gates(spark):
    shown = lambda x: F.when(x["original"] == "tree", "figure").otherwise(x["type"])
    given = pages(spark, [block(type="text", original="tree")], [block(type="text", original="x", bbox=None)], [block(type="figure", original="tree")], [])
    assert [r[0] for r in given.select(signals.fallback_mode(F.col("blocks"), shown)).collect()] == ["REGION_IMAGE", "PAGE_IMAGE", "NONE", "NONE"]
    only = pages(spark, [block(type="figure", original=" \n")], [block(type="figure", original="x")], [block(type="figure"), block(type="text", original="x")], [block(type="text")], [], None)
    assert [r[0] for r in only.select(signals.figure_only(F.col("blocks"))).collect()] == [True, False, False, False, False, False]
    full = pages(spark, [block(type="table", original="x" * 90, bbox=(0.0, 0.0, 1.0, 0.9)), block(type="text", original="y" * 10)], [block(type="table", original="x" * 80, bbox=(0.0, 0.0, 1.0, 0.9)), block(type="text", original="y" * 20)], [block(type="text", original="x", bbox=(0.0, 0.0, 1.0, 1.0))], None)
    assert [r[0] for r in full.select(signals.claims_full_page(F.col("blocks"))).collect()] == [True, False, False, False]
    thin = pages(spark, [block(type="text", original="x" * 79)], [block(type="text", original="x" * 80)], [block(type="text", original="x", bbox=(0.0, 0.0, 0.5, 0.5))], [block(type="page-number", original="7")], None)
    assert [r[0] for r in thin.select(signals.needs_recovery(F.col("blocks"))).collect()] == [True, False, False, True, True]
    body = "".join(f"第一節曆法原委…………{n}\n" for n in range(1, 7))
    toc = pages(spark, [block(type="text", original=body)], [block(type="text", original=body + "句。" * 9)], [block(type="text", original="1 2 3 4 5")], [block(type="text", source="paddle-span-2")], [])
    assert [r[0] for r in toc.select(signals.contents_candidate(F.col("blocks"))).collect()] == [True, False, False, True, False]
    wait = spark.createDataFrame([("PENDING", False, None, None), ("PENDING", True, None, None), ("PENDING", None, "manual", None), ("READY", False, None, None)], f"s string, r boolean, p string, b array<{BLOCK}>")
    assert [r[0] for r in wait.select(signals.awaits_window(F.col("s"), F.col("r"), F.col("p"), F.col("b"))).collect()] == [True, False, False, False]


def test_small_columns(spark):
    kinds = spark.createDataFrame([("figure", "text"), ("text", "figure"), ("text", "caption"), ("text", "odd"), ("page-number", "figure")], "a string, b string")
    assert [r[0] for r in kinds.select(signals.allowed_type(F.col("a"), F.col("b"))).collect()] == ["figure", "figure", "caption", "text", "page-number"]
    assert texts(spark, ["不得3", "甲", "7"], signals.window_kinds) == [["NEGATION", "NUMERIC"], ["PLAIN"], ["NUMERIC"]]
    at = spark.createDataFrame([(1, 5), (3, 5), (9, 5), (None, 1), (4, 0)], "p int, n int")
    assert [r[0] for r in at.select(signals.reading_percent(F.col("p"), F.col("n"))).collect()] == [0.0, 50.0, 100.0, 100.0, 0.0]


def test_unreadable(spark):
    given = spark.createDataFrame([(1, 0, "a", "x��□y\U0001f600￼"), (1, 1, "b", "□"), (2, 0, "c", "fine"), (2, 1, "d", None)], "page int, order int, id string, text string")
    assert rows(signals.unreadable_runs(given).select("id", "start", "end")) == [("a", 1, 3), ("a", 3, 4), ("a", 6, 7), ("b", 0, 1)]
    assert rows(signals.unreadable_runs(given, most=2).select("id", "start")) == [("a", 1), ("a", 3)]


def test_unreadable_plan(spark):
    from quire.plans.queries import QUERIES

    began = time.time()
    QUERIES["unreadable_places"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 20  # the optimizer took 53 s and 4.5 GB when it copied parts into their uses


def test_evidence_and_focus(spark):
    kind = "t string, s array<struct<start:int,end:int,resolved:boolean,replacement:string>>"
    cases = [
        ("甲乙丙丁", [(2, 3, False, None), (0, 1, True, "子丑")]), ("甲乙", [(0, 1, True, None)]), ("甲乙", [(0, 2, True, "x"), (1, 2, True, "y")]),
        ("甲乙", [(1, 3, True, "x")]), ("甲乙", []), (None, []), ("甲乙", [(None, 1, True, "x")]),
    ]
    got = [r[0] for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + kind).orderBy("i").select(signals.evidence_text(F.col("t"), F.col("s"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("子丑乙□丁", True, True), ("甲乙", False, False), None, None, ("甲乙", False, False), None, None]
    pairs = spark.createDataFrame([(0, "abXcd", "abYYcd"), (1, "ab", "ab"), (2, "aa", "aaa"), (3, "", "x"), (4, "X", "Y")], "i int, a string, b string").orderBy("i")
    assert [tuple(r[0]) for r in pairs.select(signals.focus(F.col("a"), F.col("b"))).collect()] == [("ab", "YY", "cd"), ("", "ab", ""), ("", "aaa", ""), ("", "x", ""), ("", "Y", "")]


def test_prefetch_and_findings(spark):
    near = spark.createDataFrame([("b", 10, "READY", 1), ("b", 10, "READY", 3), ("b", 11, "READY", 1), ("b", 9, "READY", 1), ("b", 12, "FAILED", 1), ("b", 16, "READY", 1)], "book_id string, page_number int, status string, revision int")
    got = signals.prefetch(near, F.lit(10)).orderBy("priority").select("page_number", "revision").collect()
    assert [tuple(r) for r in got] == [(10, 3), (11, 1), (9, 1)]
    parts = spark.createDataFrame([(1, "a", 100, "甲之乙丙")], "call int, block string, offset int, text string")
    found = [(1, "a", 1, 2, "之", "r", "之"), (1, "a", 0, 1, "丙", None, "炳"), (1, "z", 0, 1, "丙", None, None), (1, "a", 0, 1, "丁", None, None)]
    out = signals.accepted_findings(spark.createDataFrame(found, "call int, block string, start int, end int, quote string, reason string, inferred string"), parts)
    assert rows(out.select("start", "end", "inferred", "complete")) == [(101, 102, None, False), (103, 104, "炳", False)]


def test_journal(spark):
    log = spark.createDataFrame([("a", 1, "START"), ("a", 2, "DONE"), ("b", 1, "START"), ("b", 4, "STEP"), ("b", 4, "STEP")], "k string, seq long, kind string")
    assert rows(journal.sequence_faults(log, ["k"], "seq")) == [("b", 4, "GAP", 2), ("b", 4, "REUSED", 0)]
    assert rows(journal.interrupted(log, ["k"], "seq", "kind", ["DONE"])) == [("a", 2, "DONE"), ("b", 4, "INTERRUPTED")]
    mark = spark.createDataFrame([("a", 1, 10)], "k string, applied_through long, n long")
    rest = journal.tail(mark, log, ["k"], "seq")
    assert rows(rest.select("k", "seq")) == [("a", 2), ("b", 1), ("b", 4), ("b", 4)]
    assert rows(journal.resumed(mark, rest, ["k"], "seq", rest.groupBy("k").agg(F.count("*").alias("n")), ["n"])) == [("a", 2, 11), ("b", 4, 3)]
    assert rows(journal.once(log, ["k"], "seq").select("k", "kind")) == [("a", "START"), ("b", "START")]
    built = spark.createDataFrame([("a", 2), ("b", 1)], "k string, source_seq long")
    assert rows(journal.fenced(built, log, ["k"], "seq").select("k", "publish")) == [("a", True), ("b", False)]
    signs = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "x", None, None, "x"])], "k string, seq int, s string")
    assert [r["revision"] for r in journal.signature_revisions(signs, ["k"], "seq", "s").orderBy("seq").collect()] == [1, 1, 2, 2, 3]


def test_epochs_and_reservations(spark):
    day = datetime.datetime(2024, 1, 1)
    ops = spark.createDataFrame([("s", i, i != 1, day) for i in range(3)], "k string, seq int, terminal boolean, updated_at timestamp")
    got = journal.epochs(ops, ["k"], ["seq"], F.lit(day + datetime.timedelta(days=31)), size=2)
    assert rows(got.select("seq", "epoch", "archived")) == [(0, 0, True), (1, 0, False), (2, 1, True)]
    held = [("RESERVED", None, None, True), ("RESERVED", "c", None, True), ("SUBMIT_UNKNOWN", "c", None, True), ("RESERVED", None, None, False), ("TERMINAL_PROVEN", None, None, True)]
    got = journal.reclaimed(spark.createDataFrame(held, "state string, call_id string, remote_id string, stale boolean"), F.col("stale"))
    assert [(r["state"], r["holds_slot"]) for r in got.collect()] == [("TERMINAL_PROVEN", False), ("REMOTE_UNKNOWN", True), ("SUBMIT_UNKNOWN", True), ("RESERVED", True), ("TERMINAL_PROVEN", False)]


def test_lockouts_and_segments(spark):
    tries = [("a", i, float(at), ok) for i, (at, ok) in enumerate([(0, False), (1, False), (5, True), (61, True), (62, False)])]
    got = journal.lockouts(spark.createDataFrame(tries, "k string, seq int, at double, ok boolean"), "k", most=2).orderBy("seq").collect()
    assert [r["locked"] for r in got] == [False, False, True, False, False]
    glyphs = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.1, 2.0), (1, 4.0, 5.0)], "line int, x double, r double")
    assert [r["segment"] for r in journal.segments(glyphs, ["line"], ["x"], F.col("x"), F.col("r"), 0.5).orderBy("x").collect()] == [0, 0, 1]


def test_scopes_and_decisions(spark):
    asked = spark.createDataFrame([("b1",), ("b2",)], "book string")
    given = spark.createDataFrame([("b1", "ALL", 9, "x"), ("b1", "BOOK", 1, "y"), ("b1", "BOOK", 2, "z"), ("b2", "OTHER", 1, "w")], "book string, scope string, seq int, who string")
    assert [(r["book"], r["grant"] and r["grant"]["who"]) for r in journal.scoped(asked, given, ["book"], ["BOOK", "ALL"]).orderBy("book").collect()] == [("b1", "z"), ("b2", None)]
    issues = spark.createDataFrame([(1, "a", 0, 1, "甲"), (1, "a", 2, 3, "丙")], "page int, id string, start int, end int, quote string")
    said = spark.createDataFrame([(1, "a", 0, 1, "甲", 1, "NO"), (1, "a", 0, 1, "甲", 2, "YES"), (1, "a", 2, 3, "丁", 1, "YES")], "page int, id string, start int, end int, quote string, seq int, verdict string")
    assert rows(journal.decided(issues, said).select("start", "verdict")) == [(0, "YES"), (2, None)]
    found = spark.createDataFrame([(1, "a", "i2", 4, 5), (1, "a", "i1", 0, 1), (1, "a", "i1", 0, 2), (1, "zz", "i3", 0, 1)], "page int, id string, issue_id string, start int, end int")
    merged = journal.findings_merged(found, spark.createDataFrame([(1, "a"), (1, "b")], "page int, id string")).orderBy("id").collect()
    assert [[tuple(i) for i in r["issues"]] for r in merged] == [[(0, 1, "i1"), (4, 5, "i2")], []]
