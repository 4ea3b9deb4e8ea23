import json

from pyspark.sql import functions as F

from quire.operators import ledger, search
from quire.sources import index
from quire.streaming import reducers


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    lines = search.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40"))
    pages = spark.range(1, 301).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("page_number"), F.concat(F.lit("第"), "id", F.lit("页文本内容")).alias("title"))
    index.write_index(lines, pages, str(tmp_path))
    got = index.read_summaries(spark, str(tmp_path), "b", 120, 140)
    assert [r["page_number"] for r in got.collect()] == list(range(120, 141))
    assert "PartitionFilters: [isnotnull(shard" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for needle in ("Tion", "en", "a", "no such words"):
        want = search.search(lines, needle, 10_000).select("doc_id", "block_no").collect()
        assert index.find(spark, str(tmp_path), lines, needle, 10_000).select("doc_id", "block_no").collect() == want


def test_export(spark, tmp_path):
    pages = spark.createDataFrame([("b", n, f'{{"t": "</script>{n}"}}') for n in (1, 128, 129)], "book_id string, page_number int, payload string")
    outline = spark.createDataFrame([("b", 1, "甲")], "book_id string, page_number int, title string")
    lines = spark.createDataFrame([("b", n, 0, f"x{n}") for n in (3, 1, 2)], "book_id string, page_number int, `order` int, text string")
    index.write_export(pages, outline, lines, str(tmp_path), most=2)
    back = spark.read.json(str(tmp_path / "pages"))
    assert sorted((r["page_number"], r["shard"]) for r in back.collect()) == [(1, 0), (128, 0), (129, 1)]
    assert all("</script>" not in r["payload"] and json.loads(r["payload"])["t"].startswith("</script>") for r in back.collect())
    assert sorted(r["text"] for r in spark.read.json(str(tmp_path / "search")).collect()) == ["x1", "x2"]
    assert spark.read.json(str(tmp_path / "page_map")).count() == 3 and spark.read.json(str(tmp_path / "outline")).first()["title"] == "甲"


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drained(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    legal = {"view": ("click", "view"), "click": ("purchase",)}
    named = [F.col("user_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")]
    got = drained(reducers.guarded(source.select(*named), legal), "guarded")
    want = ledger.transitions(events.select(*named), ["user_id"], "seq", "state", legal).select("user_id", "seq", "state", "before", "legal")
    key = lambda r: tuple(r)[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    kept = drained(reducers.once(source, ["user_id", "event_type"], "100 days"), "kept")
    assert kept.count() == events.select("user_id", "event_type").distinct().count()
    work = [(1, "2024-01-01 00:00:00", "START"), (1, "2024-01-01 00:10:00", "DONE"), (2, "2024-01-01 00:00:00", "START"), (3, "2024-01-03 00:00:00", "START")]
    spark.createDataFrame(work, "user_id long, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "work"))
    stream = spark.readStream.schema("user_id long, ts timestamp, state string").parquet(str(tmp_path / "work"))
    assert sorted(map(tuple, drained(reducers.interrupted(stream, ["DONE"]), "ended").collect())) == [(1, "DONE"), (2, "INTERRUPTED")]
