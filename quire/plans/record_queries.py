"""Queries for the operators on records, over relations that both engines read from one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import records
from quire.plans.catalog import query, relation
from quire.plans.operator_queries import BOX

_NOW = "select o_orderkey as page, o_custkey % 6 as revision, case o_orderstatus when 'F' then 'READY' when 'O' then 'PROCESSING' else 'FAILED' end as status, o_orderpriority as text from orders"
_OLD = "select l_orderkey as page, l_linenumber + 5 as revision, 'READY' as status, l_returnflag as text from lineitem"
_NEXT = "select o_orderkey + 40 as page, o_custkey % 3 - 1 as revision, 'READY' as status, 'new' as text from orders where o_orderkey % 3 = 0"


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, _NOW, "orders")


@query(f"with c as ({_NOW}), h as ({_OLD}) select distinct * from (select * from c union all select * from h) where revision = 5")
def revision_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.revision_of(_now(spark, sf_dir), relation(spark, sf_dir, _OLD, "lineitem"), 5)


@query(f"with c as ({_NOW}), h as ({_OLD}) select page, revision from c union select page, revision from h")
def revision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.revisions(_now(spark, sf_dir), relation(spark, sf_dir, _OLD, "lineitem"))


@query(f"""with c as ({_NOW}), n as ({_NEXT})
select 'page' as place, n.page, case when c.page is null then greatest(0, n.revision) else c.revision + 1 end as revision, n.status, n.text from n left join c on c.page = n.page
union all select 'archive', c.page, c.revision, c.status, c.text from c where status in ('READY', 'FAILED') and page in (select page from n)""")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = records.published(_now(spark, sf_dir), relation(spark, sf_dir, _NEXT, "orders"))
    return new.withColumn("place", F.lit("page")).unionByName(old.withColumn("place", F.lit("archive")))


_COMMITS = """select o_custkey as page, o_orderkey as commit_id, case when o_orderstatus = 'F' then 'ABORTED' else 'PREPARED' end as state, o_orderkey % 5 as published_revision,
  o_orderkey % 5 - 1 as expected_revision, o_orderpriority as content_hash, o_orderpriority as previous_hash from orders"""
_HEADS = "select o_custkey as page, max(o_orderkey) as last_commit_id, max(o_orderkey) % 5 as revision, max_by(o_orderpriority, o_orderkey) as hash from orders where o_custkey % 9 <> 0 group by o_custkey"


@query(f"""with e as ({_COMMITS}), p as ({_HEADS}) select e.page, commit_id, case when state <> 'PREPARED' then state when commit_id = last_commit_id and published_revision = revision and content_hash = hash then 'COMMITTED'
  when expected_revision = revision and previous_hash = hash then 'NOT_PUBLISHED' else 'UNKNOWN' end as state from e left join p on p.page = e.page""")
def commit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.reconciled(relation(spark, sf_dir, _COMMITS, "orders"), relation(spark, sf_dir, _HEADS, "orders")).select("page", "commit_id", "state")


_CASES = "select o_orderkey as case_id, case when o_custkey % 11 = 0 then 'READABLE_WITH_TRUTH' else 'UNLABELED' end as status from orders where o_orderkey % 5 <> 0"
_LABELS = """select l_orderkey as case_id, case l_returnflag when 'A' then 'READABLE_WITH_TRUTH' when 'R' then 'NON_TEXT' else 'ODD' end as status, case when l_partkey % 2 = 0 then 'x' when l_partkey % 3 = 0 then ' ' end as truth
  from lineitem where l_linenumber <= 2"""
_KNOWN = ("READABLE_WITH_TRUTH", "NON_TEXT")


@query(f"""with c as ({_CASES}), l as ({_LABELS}), t as (select case_id, count(*) as times from l group by 1), k as (select l.*, times, c.case_id as known, c.status as before from l join t using (case_id) left join c on c.case_id = l.case_id)
select case_id, 'UNKNOWN' as reason from k where known is null union select case_id, 'REPEATED' from k where times > 1 union select case_id, 'LABELLED' from k where before <> 'UNLABELED'
union select case_id, 'STATUS' from k where status = 'ODD' union select case_id, 'TRUTH_MISSING' from k where status = 'READABLE_WITH_TRUTH' and coalesce(trim(truth), '') = ''
union select case_id, 'TRUTH_GIVEN' from k where status <> 'READABLE_WITH_TRUTH' and coalesce(truth, '') <> ''""")
def label_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.label_faults(relation(spark, sf_dir, _CASES, "orders"), relation(spark, sf_dir, _LABELS, "lineitem"), _KNOWN)


_RATES = "select c_mktsegment as provider, c_nationkey as model, c_custkey as position, c_acctbal as rate from customer where c_acctbal > 5000"
_CALLS = "select c_custkey as call, c_mktsegment as provider, c_nationkey as model from customer where c_custkey % 2 = 0"


@query(f"with r as ({_RATES}), c as ({_CALLS}), f as (select provider, model, min_by(rate, position) as rate from r group by 1, 2) select call, provider, model, rate from c left join f using (provider, model)")
def call_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.priced_at_start(relation(spark, sf_dir, _CALLS, "customer"), relation(spark, sf_dir, _RATES, "customer"))


_USAGE = """select l_orderkey as k, l_linenumber as n, l_partkey as p, l_shipdate as created_at, case when l_partkey % 17 = 0 then null else l_shipdate end as updated_at, case when l_partkey % 13 = 0 then '-m' else 'm.1' end as model,
  case when l_suppkey % 9 = 0 then 'ocr' else 'OCR_1' end as operation, case when l_partkey % 19 = 0 then 'other' else 'qwen' end as provider, case when l_returnflag = 'A' then 'CACHE_REUSED' else 'FAILED' end as status,
  case when l_returnflag = 'A' then 'CACHE_REUSE' when l_linestatus = 'F' then 'ESTIMATED' else 'UNKNOWN' end as fee_kind, l_linenumber - 1 as page, l_partkey - 3 as tokens_in, cast(null as bigint) as tokens_out,
  case when l_linestatus = 'F' then 'CNY' end as currency, case when l_linestatus = 'F' then l_tax end as amount from lineitem"""


@query(f"""with u as ({_USAGE}) select k, n, p, updated_at is not null and model <> '-m' and operation <> 'ocr' and provider = 'qwen' and page >= 1 and tokens_in >= 0 and not (fee_kind = 'CACHE_REUSE' and currency is not null) and not (fee_kind = 'UNKNOWN' and currency is not null) as valid
from u where not (fee_kind = 'ESTIMATED' and currency is null)""")
def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, _USAGE, "lineitem").where("not (fee_kind = 'ESTIMATED' and currency is null)").select("k", "n", "p", records.usage_valid().alias("valid"))


@query("select event_type as scenario, count(*) as n, round(median(value), 1) as median_ms, round(min(value), 1) as min_ms, round(max(value), 1) as max_ms from events group by 1")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.timings(relation(spark, sf_dir, "select event_type as scenario, value as duration_ms from events", "events"))


def _chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    parts = relation(spark, sf_dir, BOX, "lineitem").withColumn("chunk", F.floor((F.col("n") - 1) / size).cast("long"))
    one = F.struct("n", F.struct(F.col("id").alias("source_id"), F.col("p").alias("start"), (F.col("p") + F.col("s") * 30).alias("end")).alias("r"))
    return parts.groupBy("page", "chunk").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("ranges"))


@query(f"""with b as ({BOX}), c as (select page, (n - 1) // 2 as chunk, min_by(concat(id, ':', p, ':', p + s * 30), n) as f, max_by(concat(id, ':', p, ':', p + s * 30), n) as l from b group by 1, 2)
select page, chunk, concat_ws(' ', lag(l) over w, lead(f) over w) as context from c window w as (partition by page order by chunk)""")
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("context", lambda r: F.concat_ws(":", r["source_id"], r["start"], r["end"]))
    return records.chunk_context(_chunks(spark, sf_dir, 2)).select("page", "chunk", F.concat_ws(" ", said).alias("context"))


@query(f"""with b as ({BOX}), c as (select page, (n - 1) // 3 as chunk, p as a, p + s * 30 as z, n, count(*) over (partition by page, (n - 1) // 3) as k, row_number() over (partition by page, (n - 1) // 3 order by n) as i from b)
select page, chunk, case when i <= k // 2 then 0 else 1 end as part, min_by(a, n) as first_start, max_by(z, n) as last_end from c where k >= 2 group by 1, 2, 3
union all select page, chunk, 0, a, a + (z - a) // 2 from c where k = 1 and z - a >= 200 union all select page, chunk, 1, a + (z - a) // 2, z from c where k = 1 and z - a >= 200""")
def chunk_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _chunks(spark, sf_dir, 3).select("page", "chunk", F.posexplode(records.halves(F.col("ranges"))).alias("part", "r"))
    return each.select("page", "chunk", "part", F.col("r")[0]["start"].alias("first_start"), F.element_at("r", -1)["end"].alias("last_end"))


_BOOK = f"select page as book, n as page, p % 3 = 0 as chapter, case when s % 5 = 0 then ' ' else id end as text from ({BOX}) b"


@query(f"""with b as ({_BOOK}), w as (select *, max(case when chapter then page end) over (partition by book order by page) as a, min(case when chapter then page end) over (partition by book order by page rows between 1 following and unbounded following) as z from b)
select w.book, w.page, o.page as near, o.text from w join b o on o.book = w.book and abs(o.page - w.page) <= 2 and o.page <> w.page and o.page >= coalesce(a, o.page) and o.page < coalesce(z, o.page + 1) and trim(o.text) <> ''""")
def neighbour_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.evidence_near(relation(spark, sf_dir, _BOOK, "lineitem"))


@query("select user_id, event_type, min_by(event_id, event_id) as event_id, min_by(value, event_id) as value from events group by 1, 2")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "select user_id, event_type, event_id, value from events", "events")
    return records.first_by_key(rows, ["user_id", "event_type"], "event_id")


@query("select user_id, array_to_string(list_sort(list(distinct event_id % 50)), ' ') as pages from events group by 1")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.marks(relation(spark, sf_dir, "select user_id, event_id % 50 as page from events", "events"), "user_id", "page")
    return got.select("user_id", F.concat_ws(" ", F.col("pages").cast("array<string>")).alias("pages"))


@query("select c_custkey as book, c_name as title, size from customer left join (select o_custkey, max(o_orderkey % 9) as size from orders where o_orderstatus = 'F' group by 1) p on o_custkey = c_custkey")
def shelf_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = relation(spark, sf_dir, "select c_custkey as book, c_name as title from customer", "customer")
    return records.with_preferences(books, relation(spark, sf_dir, "select o_custkey as book, max(o_orderkey % 9) as size from orders where o_orderstatus = 'F' group by o_custkey", "orders"))
