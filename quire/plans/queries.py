"""Named queries over the driver's tables, with the same rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import hashing, money
from quire.functions.text import contains_folded, markup_text, substituted
from quire.operators import gates, journal, ledger, search, sequence, signals
from quire.plans import operator_queries, record_queries  # noqa: F401  their queries join the catalog
from quire.plans.catalog import ORACLES, QUERIES, query  # noqa: F401
from quire.sources.pages import in_ranges, page_ranges, read

LINES = r"""
with numbered as (
  select source, doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as block_no
  from documents),
lines as (select source, doc_id, cast(block_no as integer) as block_no, text from numbered where length(trim(text, ' ')) > 0)
"""
JOURNAL = """
with log as (
  select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k,
         case event_type when 'view' then 'PENDING' when 'click' then 'SUCCEEDED' when 'purchase' then 'SUCCEEDED'
                         when 'error' then 'FAILED' else 'CACHE_REUSED' end as status
  from events)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lines(read(spark, sf_dir, "documents"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*map(F.lit, ("view", "PENDING", "click", "SUCCEEDED", "purchase", "SUCCEEDED", "error", "FAILED", "signup", "CACHE_REUSED")))
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), status[F.col("event_type")].alias("status"))


@query(LINES + "select doc_id, block_no, text from lines where contains(lower(text), 'tion th') order by doc_id, block_no limit 100")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_lines(spark, sf_dir), "Tion th", 100).select("doc_id", "block_no", "text")


@query(LINES + "select doc_id, count(*) as hits from lines where contains(lower(text), 'ent') group by doc_id order by hits desc, doc_id limit 20")
def search_docs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of a three-letter anchor are the lines that hold it."""
    hits = _lines(spark, sf_dir).where(contains_folded(F.col("text"), "ent"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(20)


@query(LINES + """, grams as (
  select distinct doc_id, block_no, substring(lower(text), i, k) as gram, k
  from (select doc_id, block_no, text, k, unnest(range(1, length(text) - k + 2)) as i from lines, (values (1), (2), (3)) v(k) where length(text) >= k) x)
select cast(k as integer) as size, count(*) as postings, count(distinct gram) as grams from grams group by k""")
def gram_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = search.postings(_lines(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n"))
    return by.groupBy(F.length("gram").alias("size")).agg(F.sum("n").alias("postings"), F.count("*").alias("grams"))


@query("select doc_id, source from documents where doc_id between 1 and 20 or doc_id = 25 or doc_id between 40 and 60")
def page_range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(in_ranges(F.col("doc_id"), page_ranges("1-20,25,40-60", 1_000_000))).select("doc_id", "source")


@query(LINES + """select l.doc_id, count(*) as blocks, arg_min(l.text, l.block_no) as title, max(b.quality) as reviewed
from lines l left join labels b using (doc_id) group by l.doc_id""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.min_by("text", "block_no").alias("title"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("reviewed"))
    return by.join(labels, "doc_id", "left").select("doc_id", "blocks", "title", "reviewed")


@query("""select source, count(*) as docs, count(quality) as processed, cast(coalesce(sum(quality), 0) as bigint) as reviewed
from documents left join labels using (doc_id) group by source""")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("processed"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("reviewed"))


@query("""with s as (select conv_id, turn, case when role = 'assistant' then 1 else 0 end as a from conversations),
d as (select conv_id, a - coalesce(lag(a) over (partition by conv_id order by turn), 0) as delta from s)
select conv_id, cast(sum(delta) as bigint) as state, cast(sum(abs(delta)) as bigint) as changes from d group by conv_id""")
def count_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = (F.col("role") == "assistant").cast("long")
    before = F.coalesce(F.lag(now).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0))
    deltas = read(spark, sf_dir, "conversations").select("conv_id", (now - before).alias("delta"))
    return deltas.groupBy("conv_id").agg(F.sum("delta").alias("state"), F.sum(F.abs("delta")).alias("changes"))


@query(LINES + """, edge as (
  select source, doc_id, regexp_replace(text, '\\s+', '', 'g') as text, block_no = min(block_no) over d as top, block_no = max(block_no) over d as bottom
  from lines window d as (partition by doc_id)),
zoned as (select source, doc_id, text, case when top then 'TOP' else 'BOTTOM' end as zone from edge where (top or bottom) and length(text) <= 120)
select source, zone, text, count(distinct doc_id) as page_count, min(doc_id) as first_page from zoned group by all having count(distinct doc_id) >= 3""")
def edge_line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_doc = Window.partitionBy("doc_id")
    edge = _lines(spark, sf_dir).select("source", "doc_id", F.regexp_replace("text", r"\s+", "").alias("text"), (F.col("block_no") == F.min("block_no").over(of_doc)).alias("top"), (F.col("block_no") == F.max("block_no").over(of_doc)).alias("bottom"))
    zoned = edge.where("(top or bottom) and length(text) <= 120").withColumn("zone", F.when(F.col("top"), "TOP").otherwise("BOTTOM"))
    return zoned.groupBy("source", "zone", "text").agg(F.count_distinct("doc_id").alias("page_count"), F.min("doc_id").alias("first_page")).where("page_count >= 3")


@query(LINES + """, freq as (select doc_id, text, count(*) as n from lines group by doc_id, text)
select doc_id, cast(sum(n) as bigint) as lines, count(*) as distinct_lines, max(n) as top from freq group by doc_id having max(n) >= 2""")
def repeated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = _lines(spark, sf_dir).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return freq.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"), F.max("n").alias("top")).where("top >= 2")


@query("select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading, 1 as level from pages where regexp_matches(html, '<h1>[^<]*</h1>')")
def outline_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.where(F.col("html").rlike("<h1>[^<]*</h1>")).select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.lit(1).alias("level"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", markup_text(F.col("html")).alias("text"))


@query("""with c as (select source, lang, count(*) as n, cast(sum(length(text)) as bigint) as chars,
  cast(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) as bigint) as latin, cast(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) as bigint) as digits
  from documents group by source, lang),
m as (select source, lang, row_number() over (partition by source order by n desc, lang) as r from c)
select c.source, cast(sum(n) as bigint) as docs, cast(sum(chars) as bigint) as chars, cast(sum(latin) as bigint) as latin, cast(sum(digits) as bigint) as digits, min(m.lang) as main_lang
from c join m on m.source = c.source and m.r = 1 group by c.source""")
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = lambda what: F.sum(F.length(F.regexp_replace("text", f"[^{what}]", "")))
    by = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), only("A-Za-z").alias("latin"), only("0-9").alias("digits"))
    vote = F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"]  # most documents, ties by name
    return by.groupBy("source").agg(F.sum("n").alias("docs"), F.sum("chars").alias("chars"), F.sum("latin").alias("latin"), F.sum("digits").alias("digits"), vote.alias("main_lang"))


@query(LINES + "select doc_id, min(block_no) as block_no, arg_min(text, block_no) as line from lines where regexp_matches(text, '^(The|De|La|Der) ') group by doc_id")
def chapters_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.col("text").rlike("^(The|De|La|Der) ")).groupBy("doc_id").agg(F.min("block_no").alias("block_no"), F.min_by("text", "block_no").alias("line"))


@query("""with r as (select source, n_chars, row_number() over (partition by source order by n_chars, doc_id) as i, count(*) over (partition by source) as n from documents)
select source, max(n) as docs, min(n_chars) as least, max(n_chars) as most, max(case when i = n // 2 + 1 then n_chars end) as upper_median, cast(sum(n_chars) as bigint) as chars from r group by source""")
def inventory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Window.partitionBy("source")
    rows = read(spark, sf_dir, "documents").select("source", "n_chars", F.row_number().over(of.orderBy("n_chars", "doc_id")).alias("i"), F.count("*").over(of).alias("n"))
    middle = F.max(F.when(F.expr("i = n div 2 + 1"), F.col("n_chars")))
    return rows.groupBy("source").agg(F.max("n").alias("docs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), middle.alias("upper_median"), F.sum("n_chars").alias("chars"))


@query("""with g as (select quality, doc_id, doc_id - row_number() over (partition by quality order by doc_id) as i from labels)
select quality, min(doc_id) as first, max(doc_id) as last, count(*) as n from g group by quality, i""")
def ranges_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ranges(read(spark, sf_dir, "labels"), ["quality"], "doc_id")


@query("""with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) - 1 as position, row_number() over (partition by conv_id, role order by turn) as k from conversations)
select conv_id, turn, position, case when k = 1 then role else role || '-' || k end as name from r""")
def order_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long") - 1
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", position.alias("position"), sequence.suffixed(F.col("role"), ["conv_id"], ["turn"]).alias("name"))


@query("""select conv_id, turn, lag(left(text, 40)) over w as before, lead(left(text, 40)) over w as after,
  cast(sum(length(text)) over (partition by conv_id order by turn rows between 2 preceding and 2 following) as bigint) as near_chars
from conversations window w as (partition by conv_id order by turn)""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = F.left("text", F.lit(40))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag(text).over(w).alias("before"), F.lead(text).over(w).alias("after"), F.sum(F.length("text")).over(w.rowsBetween(-2, 2)).alias("near_chars"))


@query("""select e.event_id, e.user_id, s.event_id as signup from (select * from events where event_type <> 'signup') e
asof left join (select user_id, ts, event_id from events where event_type = 'signup') s on e.user_id = s.user_id and e.ts >= s.ts""")
def last_chapter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("at"), F.col("event_id").alias("signup"))
    left = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts", F.col("event_id").alias("at"))
    return sequence.asof(left, right, ["user_id"], "ts", ["at"], "signup").select("event_id", "user_id", "signup")


@query("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls)
  over (partition by user_id order by ts, event_id rows between 12 preceding and 1 preceding) as signup from events""")
def bounded_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", sequence.last_within(["user_id"], ["ts", "event_id"], value, 12).alias("signup"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role from conversations group by conv_id")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("""with s as (select event_id, user_id, event_type as state, lag(event_type) over (partition by user_id order by event_id) as before from events)
select * from s where before is not null and not ((before = 'signup' and state in ('view', 'click')) or (before = 'view' and state in ('view', 'click', 'error'))
  or (before = 'click' and state in ('purchase', 'view', 'error')) or (before = 'error' and state in ('view', 'click')))""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = {"signup": ("view", "click"), "view": ("view", "click", "error"), "click": ("purchase", "view", "error"), "error": ("view", "click"), "purchase": ()}
    steps = ledger.transitions(read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("state")), ["user_id"], "event_id", "state", legal)
    return steps.where("not legal").select("event_id", "user_id", "state", "before")


@query(JOURNAL + """, p as (select user_id, k, bool_or(event_type = 'view') as p, bool_or(event_type = 'purchase') as c, bool_or(event_type = 'error') as n from log group by user_id, k)
select user_id, k, case when c and n then 'CONTRADICTION' when not p then 'UNPREPARED' when c then 'COMMITTED' when n then 'NOT_PUBLISHED' else 'PENDING' end as outcome from p""")
def two_phase_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*map(F.lit, ("view", "PREPARED", "purchase", "COMMITTED", "error", "NOT_PUBLISHED", "click", "OTHER", "signup", "OTHER")))
    log = _log(spark, sf_dir).withColumn("state", state[F.col("event_type")])
    return ledger.two_phase(log, ["user_id", "k"], "state")


@query(JOURNAL + """, h as (select event_id, user_id, k, max(k) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as high from log)
select event_id, user_id, k from h where high is null or k > high""")
def late_event_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.in_order(_log(spark, sf_dir).select("event_id", "user_id", "k"), ["user_id"], "event_id", "k")


@query("""with m as (select user_id, event_id, event_type = 'error' as hit, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as run from events)
select user_id, min(event_id) as start, count(*) as length from m where hit group by user_id, run having count(*) >= 2""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.streaks(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error").where("length >= 2")


@query("""with m as (select user_id, ts, event_id, case when ts <= lag(ts) over w + interval 2 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as i from m)
select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n from s group by user_id, i""")
def lease_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sessions(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", "2 HOURS").select("user_id", "session_start", "session_end", "n")


_FEE = "case when status = 'SUCCEEDED' then cast(case when user_id % 2 = 0 then 0.2 when k % 10 = 0 then null else cast(k * 1000 as decimal(18,0)) * 2 / 1000000 + cast(k * 500 as decimal(18,0)) * 4 / 1000000 end as decimal(38,12)) end"
_TOTALS = """count(*) filter (where status <> 'CACHE_REUSED') as requests, count(*) filter (where status = 'SUCCEEDED') as succeeded,
  count(*) filter (where status = 'FAILED') as failed, count(*) filter (where status = 'PENDING') as pending, count(*) filter (where status = 'CACHE_REUSED') as cache_hits,
  cast(sum(case when status <> 'CACHE_REUSED' and k % 10 <> 0 then k * 1000 end) as bigint) as tokens_in,
  count(*) filter (where status <> 'CACHE_REUSED' and k % 10 = 0) as unknown_in"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with tokens (unknown where k is a multiple of 10) and fees; even users pay per request in one currency."""
    known = F.when(F.col("k") % 10 != 0, F.col("k"))
    even = F.col("user_id") % 2 == 0
    fee = money.fee(F.when(even, F.lit("0.2").cast(money.KIND)), F.lit(2), F.lit(4), known * 1000, known * 500)
    paid = F.when(F.col("status") == "SUCCEEDED", fee)
    return _log(spark, sf_dir).select("event_id", "user_id", "event_type", "status", F.when(even, "CNY").otherwise("USD").alias("currency"), (known * 1000).alias("tokens_in"), (known * 500).alias("tokens_out"), paid.alias("amount"))


@query(JOURNAL + f"select user_id, {_TOTALS} from log group by user_id")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_calls(spark, sf_dir), ["user_id"]).drop("unpriced").withColumn("tokens_in", F.col("tokens_in").cast("long"))


@query(JOURNAL + f"select event_type, user_id % 2 as model, {_TOTALS} from log group by event_type, user_id % 2")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("model", F.col("user_id") % 2)
    return ledger.usage(calls, ["event_type", "model"]).drop("unpriced").withColumn("tokens_in", F.col("tokens_in").cast("long"))


@query(JOURNAL + f"select case when user_id % 2 = 0 then 'CNY' else 'USD' end as currency, cast(round(sum({_FEE}), 6) as double) as amount, count({_FEE}) as priced from log group by 1")
def usage_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).groupBy("currency").agg(F.round(F.sum("amount"), 6).cast("double").alias("amount"), F.count("amount").alias("priced"))


@query(JOURNAL + f"select event_id, cast({_FEE} as double) as amount from log where status = 'SUCCEEDED'")
def fee_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).where("status = 'SUCCEEDED'").select("event_id", F.col("amount").cast("double").alias("amount"))


@query(JOURNAL + """select user_id, cast(sum(case when event_type in ('view', 'click') then k end) as bigint) as reserved,
  cast(sum(case when event_type = 'purchase' then k end) as bigint) as reported, count(*) as attempts from log group by user_id""")
def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("view", "click"), "RESERVED").when(F.col("event_type") == "purchase", "REPORTED").otherwise("RELEASED")
    return ledger.budget(_log(spark, sf_dir).select("user_id", state.alias("state"), F.col("k").alias("reserved"), F.col("k").alias("reported")), ["user_id"])


@query("select user_id, count(*) as attempts from events where starts_with(event_type, 'p') group by user_id")
def attempts_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_type").startswith("p")).groupBy("user_id").agg(F.count("*").alias("attempts"))


@query("""with c as (select user_id, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click') as b, count(*) filter (where event_type in ('click', 'error')) as t, count(*) as n from events group by user_id)
select user_id, cast(least(99, 30 * least(a, 10) // 10 + case when t > 0 then 35 * b // t else 0 end + 20 * least(n, 100) // 100) as bigint) as percent from c""")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(n("view").alias("a"), n("click").alias("b"), n("click", "error").alias("t"), F.count("*").alias("n"))
    done = {"OCR": (F.col("a"), F.lit(10)), "REVIEW": (F.col("b"), F.col("t")), "STRUCTURE": (F.col("n"), F.lit(100))}
    return by.select("user_id", ledger.percent(done, F.lit(False)).alias("percent"))


@query("select ts, event_id, user_id from events where (ts, event_id) > (timestamp '2024-01-10 00:00:00', 100) order by ts, event_id limit 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    stamp = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return events.where((F.col("ts") > stamp) | ((F.col("ts") == stamp) & (F.col("event_id") > 100))).orderBy("ts", "event_id").limit(50)


@query("select event_id, user_id from events order by event_id limit 100 offset 500")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id").orderBy("event_id").offset(500).limit(100)


@query("select event_id, value from events where event_id <= 700 order by event_id desc limit 25")
def frozen_prefix_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.frozen(read(spark, sf_dir, "events"), "event_id", 700).select("event_id", "value").orderBy(F.desc("event_id")).limit(25)


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 5")
def revision_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 5)


@query("select conv_id, min(turn) as turn, arg_min(role, turn) as role from conversations group by conv_id")
def first_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.pages import first_original as first

    return first(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query(r"""with q as (select item_id, array_to_string((regexp_extract_all(text, '[^\x20\x09-\x0D]+'))[1:6], ' ') as quote from benchmark),
d as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, array_to_string(w[i : i + 5], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 4)) as i from d where len(w) >= 6) y)
select q.item_id, x.doc_id, case when count(*) = 1 then 'OK' else 'LOCATION_AMBIGUOUS' end as code from q join x on x.g = q.quote group by q.item_id, x.doc_id""")
def quote_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes found through an equality join on their first six words; how often each stands in a document decides."""
    word = F.lit(r"[^\x20\x09-\x0D]+")
    split = lambda: F.regexp_extract_all("text", word, F.lit(0))
    quotes = read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(split(), 1, 6), " ").alias("g"))
    docs = read(spark, sf_dir, "documents").select("doc_id", split().alias("w")).where(F.size("w") >= 6)
    grams = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, F.lit(6)), " "))).alias("g"))
    hits = grams.join(quotes, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    return hits.select("item_id", "doc_id", F.when(F.col("n") == 1, "OK").otherwise("LOCATION_AMBIGUOUS").alias("code"))


@query("select doc_id, case when length(text) >= 20 then left(text, 5) || '<' || substring(text, 6, 5) || '>' || substring(text, 11) else text end as text from documents")
def span_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<"), F.substring("text", 6, 5), F.lit(">"))
    span = F.when(F.length("text") >= 20, F.array(F.struct(F.lit(5).alias("start"), F.lit(10).alias("end"), marked.alias("value")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))
    return read(spark, sf_dir, "documents").select("doc_id", substituted(F.col("text"), span).alias("text"))


_SPANS = "select l_orderkey, l_linenumber, cast(l_partkey % 40 as integer) as s, cast(l_partkey % 40 + l_quantity as integer) as e from lineitem"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 40).cast("int")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"))


@query(f"with s as ({_SPANS}) select a.l_orderkey, a.l_linenumber as a, b.l_linenumber as b from s a join s b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.s < b.e and b.s < a.e")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.overlaps(_spans(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query(f"""with s as ({_SPANS}), t as (select * from s where l_linenumber = 1), j as (
  select a.l_orderkey, a.l_linenumber, case when a.s = t.s and a.e = t.e then 'EXACT' when a.s <= t.s and a.e >= t.e then 'EXPANDED_SPAN' else 'UNALIGNED' end as alignment from s a join t using (l_orderkey))
select alignment, count(*) as n from j group by alignment""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    target = spans.where("l_linenumber = 1").select("l_orderkey", F.col("start").alias("t0"), F.col("end").alias("t1"))
    joined = spans.join(target, "l_orderkey")
    return joined.groupBy(gates.alignment(F.col("start"), F.col("end"), F.col("t0"), F.col("t1")).alias("alignment")).agg(F.count("*").alias("n"))


_BOXES = "select l_orderkey, l_linenumber, l_linestatus, l_discount as x, l_tax as y, l_quantity / 100 as w, 0.3 as h from lineitem"


@query(f"""with b as ({_BOXES}),
p as (select a.l_orderkey, a.l_linenumber as a, c.l_linenumber as b,
  greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0.0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0.0) as o, a.w * a.h as m, c.w * c.h as n
  from b a join b c on a.l_orderkey = c.l_orderkey and a.l_linestatus = 'F' and c.l_linestatus = 'O')
select l_orderkey, a, count(*) as pairs, round(max(o / (m + n - o)), 6) as best from p where o / (m + n - o) >= 0.5 group by l_orderkey, a""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 100).alias("w"), F.lit(0.3).alias("h"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", box.alias("box"))
    a = rows.where("l_linestatus = 'F'").select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("box").alias("p"))
    b = rows.where("l_linestatus = 'O'").select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("box").alias("q"))
    pairs = a.join(b, "l_orderkey").withColumn("iou", geo.iou(F.col("p"), F.col("q"))).where("iou >= 0.5")
    return pairs.groupBy("l_orderkey", "a").agg(F.count("*").alias("pairs"), F.round(F.max("iou"), 6).alias("best"))


@query("""select l.doc_id, case when d.doc_id is null then 'MISSING' else 'MISMATCH' end as reason from labels l left join documents d on d.doc_id = l.doc_id + 600
where d.doc_id is null or d.n_chars % 2 <> l.quality""")
def stale_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("doc_id") + 600).alias("block"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("block"), "n_chars")
    joined = labels.join(docs, "block", "left").where("n_chars is null or n_chars % 2 <> quality")
    return joined.select("doc_id", F.when(F.col("n_chars").isNull(), "MISSING").otherwise("MISMATCH").alias("reason"))


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""with a as (select conv_id, turn, case when turn % 7 = 3 then upper(role) else role end as role from conversations where turn % 5 <> 4)
select c.conv_id, c.turn, case when a.conv_id is null then 'LOST' else 'CHANGED' end as reason from conversations c left join a using (conv_id, turn) where a.conv_id is null or a.role <> c.role""")
def diff_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = before.where("turn % 5 <> 4").withColumn("role", F.when(F.col("turn") % 7 == 3, F.upper("role")).otherwise(F.col("role")))
    return gates.diff(before, after, ["conv_id", "turn"], "role")


@query("select o_orderkey, count(l_orderkey) as times from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey having count(l_orderkey) <> 1")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return gates.coverage(read(spark, sf_dir, "orders"), used, "o_orderkey")


@query("select conv_id, count(*) = max(turn) + 1 and count(distinct turn) = count(*) as complete from conversations group by conv_id")
def permutation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return by.select("conv_id", gates.is_permutation(F.col("turns"), F.sequence(F.lit(0).cast("long"), F.array_max("turns"))).alias("complete"))


@query("""with m as (select user_id, cast(floor(value) as bigint) as text, min(case event_type when 'purchase' then 1 when 'click' then 2 when 'view' then 3 when 'signup' then 4 else 5 end) as r, count(distinct event_type) as kinds from events group by 1, 2),
p as (select *, row_number() over (partition by user_id order by r, text) as place from m)
select user_id, text, kinds, cast(place as integer) as place, place > 6 as dropped from p""")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").select("user_id", F.floor("value").alias("text"), "event_type")
    got = gates.candidates(found, ["user_id"], "text", "event_type", ["purchase", "click", "view", "signup", "error"])
    return got.select("user_id", "text", F.size("kinds").cast("long").alias("kinds"), "place", "dropped")


_CASES = "select lang, source, l.quality as truth, case when n_chars > 800 then 1 when n_chars > 400 then 0 end as picked, n_chars % 3 <> 0 as offered from documents join labels l using (doc_id)"
_METRICS = """count(*) as cases, round(count(*) filter (where offered) / count(*), 6) as recall,
  round(count(*) filter (where offered and picked = truth) / nullif(count(*) filter (where offered and picked is not null), 0), 6) as accuracy,
  round(count(picked) / count(*), 6) as answered"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    picked = F.when(F.col("n_chars") > 800, 1).when(F.col("n_chars") > 400, 0)
    return joined.select("lang", "source", F.col("quality").alias("truth"), picked.alias("picked"), (F.col("n_chars") % 3 != 0).alias("offered"))


@query(f"with c as ({_CASES}) select lang, {_METRICS} from c group by lang")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.metrics(_cases(spark, sf_dir), ["lang"])


@query(f"with c as ({_CASES}), t as (select *, unnest([lang, source]) as tag from c) select tag, {_METRICS} from t group by tag")
def eval_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.metrics(_cases(spark, sf_dir).withColumn("tag", F.explode(F.array("lang", "source"))), ["tag"])


@query("select doc_id, sha256(length(lang) || ':' || lang || length(source) || ':' || source || length(text) || ':' || text) as identity from documents")
def hash_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashing.identity(F.col("lang"), F.col("source"), F.col("text")).alias("identity"))


@query("""with recursive n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events),
c as (select user_id, i, sha256(':' || event_id || ':' || event_type) as h from n where i = 1
  union all select n.user_id, n.i, sha256(c.h || ':' || n.event_id || ':' || n.event_type) from c join n on n.user_id = c.user_id and n.i = c.i + 1)
select user_id, max(i) as events, arg_max(h, i) as head from c group by user_id""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("id"))).alias("log"))
    return by.select("user_id", F.size("log").cast("long").alias("events"), hashing.chain(F.col("log")).alias("head"))


@query(JOURNAL + "select event_type, cast(sum(k) as bigint) as units, count(k) as known from log group by event_type")
def json_usage_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.units")).cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("units"), F.count(k).alias("known"))


@query()
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.packed(_lines(spark, sf_dir), "doc_id")


@query("""with s as (select distinct doc_id from documents where lang = 'en'), t as (select distinct doc_id from labels)
select 'both' as part, count(*) as n from (select doc_id from s intersect select doc_id from t) x
union all select 'left', count(*) from (select doc_id from s except select doc_id from t) x
union all select 'either', count(*) from (select doc_id from s union select doc_id from t) x""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").distinct()
    t = read(spark, sf_dir, "labels").select("doc_id").distinct()
    n = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n("both", s.intersect(t)).unionByName(n("left", s.subtract(t))).unionByName(n("either", s.union(t).distinct()))


@query("""select n_name, o_orderpriority, count(*) as orders, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue
from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey
where l_shipdate >= timestamp '1995-01-01' and c_mktsegment = 'BUILDING' group by n_name, o_orderpriority""")
def generic_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    customers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    joined = lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))


@query(JOURNAL + """, s as (select user_id, k, event_id, k - lag(k) over (partition by user_id order by k, event_id) as step from log where event_type <> 'signup')
select user_id, k, case when step = 0 then 'REUSED' else 'GAP' end as fault, cast(count(*) as bigint) as n, cast(sum(greatest(step - 1, 0)) as bigint) as missing
from s where step = 0 or step > 1 group by user_id, k, fault""")
def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).where("event_type <> 'signup'")
    return journal.sequence_faults(log, ["user_id"], "k").groupBy("user_id", "k", "fault").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))


@query("""select user_id, max(event_id) as last, coalesce(arg_max(event_type, event_id) filter (where event_type in ('purchase', 'error')), 'INTERRUPTED') as state
from events group by user_id""")
def interrupted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.interrupted(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", ["purchase", "error"])


@query("""select user_id, max(event_id) as applied_through, count(*) as n, count(*) filter (where event_type = 'purchase') as bought from events group by user_id""")
def checkpoint_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from a checkpoint over the even-numbered half of each user's log, and the tail: the same as over the whole log."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    counts = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("applied_through"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    half = events.groupBy("user_id").agg(F.floor(F.avg("event_id")).alias("_half"))
    mark = counts(events.join(half, "user_id").where("event_id <= _half"))
    rest = journal.tail(mark, events, ["user_id"], "event_id")
    return journal.resumed(mark, rest, ["user_id"], "event_id", counts(rest), ["n", "bought"])


@query("""with m as (select user_id, event_id, event_type, case when event_type is not distinct from lag(event_type) over w and lag(event_id) over w is not null then 0 else 1 end as moved from events window w as (partition by user_id order by event_id))
select user_id, event_id, event_type, cast(sum(moved) over (partition by user_id order by event_id) as bigint) as revision from m""")
def profile_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.signature_revisions(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by user_id, event_type")
def operations_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.once(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""with recursive o as (select user_id, event_id, epoch(ts) as at, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (
  select user_id, event_id, i, false as locked, case when ok then 0 else 1 end as fails, cast(-1 as double) as until from o where i = 1
  union all
  select o.user_id, o.event_id, o.i, o.at < f.until, case when o.at < f.until then f.fails when o.ok then 0 else f.fails + 1 end,
         case when o.at >= f.until and not o.ok and f.fails + 1 >= 2 then o.at + 21600 else f.until end
  from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, event_id, locked from f""")
def failure_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    tries = events.select("user_id", F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return journal.lockouts(tries, "user_id", seconds=21600.0, most=2).select("user_id", F.col("seq").alias("event_id"), "locked")


_NUMBERED = "'^(?:[一二三四五六七八九十百]+[、.．]|[（(][一二三四五六七八九十百0-9]+[)）]|[0-9]+[、.．])'"


@query("""with r as (select doc_id, [trim(x, ' ' || chr(9) || chr(11) || chr(12)) for x in string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))] as l from documents),
c as (select doc_id, len([x for x in l if x <> '']) as n, len([x for x in l if regexp_matches(x, """ + _NUMBERED + """)]) as hits from r)
select doc_id, hits >= 2 and 2 * hits >= n as numbered from c""")
def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", signals.is_numbered(F.col("text")).alias("numbered"))


@query("""select doc_id, case when n = 0 then 0.0 when n = 1 then 100.0 else (rank - 1) * 100.0 / (n - 1) end as percent
from (select doc_id, row_number() over (partition by source order by doc_id) as rank, count(*) over (partition by source) as n from documents)""")
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source")
    placed = read(spark, sf_dir, "documents").select("doc_id", F.row_number().over(by.orderBy("doc_id")).alias("rank"), F.count("*").over(by).alias("n"))
    return placed.select("doc_id", signals.reading_percent(F.col("rank"), F.col("n")).alias("percent"))


@query("""with p as (select doc_id, source, row_number() over (partition by source order by doc_id) as page from documents)
select source, page, case when page >= 7 then page - 7 else 10 + 7 - page end as priority from p where abs(page - 7) <= 5""")
def prefetch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    given = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), page.alias("page_number"), F.lit("READY").alias("status"), F.lit(0).alias("revision"))
    return signals.prefetch(given, F.lit(7)).select(F.col("book_id").alias("source"), F.col("page_number").cast("long").alias("page"), F.col("priority").cast("long").alias("priority"))


@query("""with w as (select user_id, k, lag(lower(event_type)) over (partition by user_id order by event_id) as a, event_type as b, event_id from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)),
x as (select event_id, a, b, list_max(list_concat([0], [i for i in range(1, least(length(a), length(b)) + 1) if left(a, i) = left(b, i)])) as l from w where a is not null),
y as (select event_id, a, b, l, list_max(list_concat([0], [i for i in range(1, least(length(a), length(b)) - l + 1) if right(a, i) = right(b, i)])) as r from x)
select event_id, case when length(a) - l - r > 0 and length(b) - l - r > 0 then substr(b, l + 1, length(b) - l - r) else b end as focus from y""")
def focused_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    pairs = read(spark, sf_dir, "events").select("event_id", before.alias("a"), F.col("event_type").alias("b")).where("a is not null")
    return pairs.select("event_id", signals.focus(F.col("a"), F.col("b"))["focus"].alias("focus"))
