"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how often the mix takes it. Of all rates from 0 to ``MOST`` that give every source its
target of words and keep the mix's mean length class that of the corpus, those nearest to "every document once", in
Kullback-Leibler divergence weighted by words, are exponentially tilted: rate = least(``MOST``, exp(lambda of the
source + mu * length class)), with the length class the binary logarithm of a document's words. The convex dual is
solved by Newton iterations: for a mu, each source solves its own lambda beside the others from its words by class, and
mu moves by sums over all sources, one distributed aggregation an iteration. Where the constraint on lengths cannot
be met within ``STEEPEST``, mu stays there; the sources' constraints are always met.

Rates are then rounded into copies: whole copies for every document, and one copy more in the order of a hash divided
by the rate's fraction until the source's target is met; the last of them is cut to what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.rules import WORD, _let
from quire.llm.tables import written

#: Weights of the sources in code point order, null last, repeating; the mix as a share of all words; most copies.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton iterations for mu and, within each, for lambda; the largest mu and lambda on either side.
ROUNDS, STEPS, STEEPEST, WIDEST = 6, 40, 0.5, 60.0


def _numbered(by: DataFrame) -> DataFrame:
    """``by(source, ...)`` with ``number``, the place of the source in code point order, null last, from 0.

    Sources are dealt out by range and numbered within a range; only the counts by range are put in order together.
    """
    name = F.coalesce(F.col("source"), F.lit(""))
    placed = written(by.repartitionByRange(F.col("source").isNull(), name).withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "source"))
    return placed.withColumn("own", own).join(F.broadcast(before), "range").select(*[c for c in by.columns], (F.col("before") + F.col("own") - 1).alias("number"))


def _level(by: DataFrame) -> float:
    """The level at which targets of least(weight * level, cap) add up to the mix; each pass is one aggregation.

    The level grows from pass to pass, as sources whose cap lies below it are set aside, until no more of them are found.
    """
    level, done = 0.0, -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        r = by.agg(
            F.sum("source_size").alias("all"), F.count_if(capped).alias("n"),
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if r["n"] == done or not r["weights"]:
            return level
        done = r["n"]
        level = (r["all"] * SHARE - r["used"]) / r["weights"]


def _tilt(x: Column, z: Column, mu: float) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(x + F.lit(mu) * z))


def _solved(mu: float) -> Column:
    """The lambda that gives a source its target for ``mu``, by Newton steps over its words by class.

    A step that would leave the interval in which lambda is known to lie goes to its middle.
    """

    def step(s: Column, _: Column) -> Column:
        rate = lambda c: _tilt(s["x"], c["z"], mu)
        got = F.aggregate("cells", F.lit(0.0), lambda t, c: t + c["words"] * rate(c))
        slope = F.aggregate("cells", F.lit(0.0), lambda t, c: t + F.when(rate(c) < MOST, c["words"] * rate(c)).otherwise(0.0))

        def moved(g: Column) -> Column:
            low = g["got"] <= F.col("target")
            newton = F.when(g["slope"] > 0, s["x"] + (F.col("target") - g["got"]) / g["slope"])
            return _let(F.struct(F.when(low, s["x"]).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(s["x"]).alias("hi"), newton.alias("x")), kept)

        def kept(b: Column) -> Column:
            inside = (b["x"] > b["lo"]) & (b["x"] < b["hi"])
            return F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), F.when(inside, b["x"]).otherwise((b["lo"] + b["hi"]) / 2).alias("x"))

        return _let(F.struct(got.alias("got"), slope.alias("slope")), moved)

    start = F.struct(F.lit(-WIDEST).alias("lo"), F.lit(WIDEST).alias("hi"), F.lit(0.0).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["x"]


def _sums(plan: DataFrame, mu: float) -> tuple[float, float]:
    """The excess of the length constraint at ``mu`` and its slope along the solved lambdas, over all sources."""
    solved = plan.where("target < cap and target > 0").select("cells", "target", _solved(mu).alias("x"))
    rate = lambda c: _tilt(F.col("x"), c["z"], mu)
    free = lambda c: F.when(rate(c) < MOST, c["words"] * rate(c)).otherwise(0.0)
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda s, c: s + f(c))
    each = solved.select(
        total(lambda c: c["words"] * rate(c) * c["z"]).alias("m"), total(free).alias("a"),
        total(lambda c: free(c) * c["z"]).alias("b"), total(lambda c: free(c) * c["z"] * c["z"]).alias("c"),
    )
    slope = F.when(F.col("a") > 0, F.col("c") - F.col("b") * F.col("b") / F.col("a")).otherwise(0.0)
    r = each.agg(F.sum("m").alias("m"), F.sum(slope).alias("s")).first()
    return r["m"] or 0.0, r["s"] or 0.0


def _mu(plan: DataFrame) -> float:
    """Newton iterations on mu."""
    words = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["words"])
    moment = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["words"] * c["z"])
    full = F.when((F.col("target") >= F.col("cap")) & (F.col("target") > 0), moment * MOST).otherwise(0.0)
    r = plan.agg(F.sum(words).alias("words"), F.sum(moment).alias("moment"), F.sum("target").alias("target"), F.sum(full).alias("full")).first()
    if not r["words"]:
        return 0.0
    wanted = r["moment"] / r["words"] * r["target"] - r["full"]
    mu = 0.0
    for _ in range(ROUNDS):
        got, slope = _sums(plan, mu)
        if slope <= 0:
            break
        mu = round(max(-STEEPEST, min(STEEPEST, mu + (wanted - got) / slope)), 9)
    return mu


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target, cap, cells)`` of each source of ``sizes(source, size)``.

    A target stops at ``MOST`` times its source's size; what is above is reshared by weight among the others. ``cells``
    holds a source's words by length class, a few dozen at most.
    """
    z = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int")
    cells = sizes.groupBy("source", z.alias("z")).agg(F.sum("size").alias("words"))
    held = F.sort_array(F.collect_list(F.struct("z", F.col("words").cast("double").alias("words"))))
    by = _numbered(cells.groupBy("source").agg(F.sum("words").alias("source_size"), held.alias("cells")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")).cast("double")
    by = written(by.select("source", "source_size", "cells", weight.alias("weight"), (F.col("source_size") * float(MOST)).alias("cap")))
    return by.select("source", "source_size", "cells", "cap", F.least("cap", F.col("weight") * _level(by)).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``rate``, ``copies``.

    Null texts have size 0; rows without words take none. A null source is a source, the last. Ties in the order are
    broken by a hash of ``doc_id``, by ``doc_id`` and by size; rows equal in all of these share their places. An empty
    table gives an empty one. Reruns agree. Sums of a source run over buckets first, so no source is one task's work.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = written(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("at")))
    plan = targets(sizes)
    mu = _mu(plan)
    plan = written(plan.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("target") <= 0, F.lit(-100.0)).when(F.col("target") >= F.col("cap"), F.lit(100.0)).otherwise(_solved(mu)).alias("x")))
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"])).drop("s")
    rate = F.when(F.col("size") > 0, F.round(_tilt(F.col("x"), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))), mu), 9)).otherwise(0.0)
    part = F.col("rate") - F.floor("rate")
    chance = F.conv(F.substring("at", 1, 8), 16, 10).cast("double") / 4294967296.0
    # the smaller, the sooner a document gets one copy more
    odds = F.greatest(chance, F.lit(1e-9))
    turn = F.when(F.col("size") == 0, 2 + chance).when(part == 0, 1 + chance).otherwise(odds / (odds + part))
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("turn", turn)
    rows = written(rows.withColumn("bucket", F.floor(F.col("turn") * 4096)).drop("x"))
    # a source's words in whole copies, and in one copy each by bucket; buckets are few, whatever the source's size
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.floor(F.col("target") + 1e-6) - F.sum("certain").over(Window.partitionBy("source"))
    places = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("ahead"), rest.alias("rest"))
    inner = Window.partitionBy("source", "bucket").orderBy("turn", "at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(places, rows["source"].eqNullSafe(places["s"]) & (rows["bucket"] == places["b"]))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("near")))
    taken = F.least(F.col("whole") * F.col("size") + extra, F.col("size") * MOST).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "rate", F.ceil(taken / F.expr("nullif(size, 0)")).alias("copies"))


def _mixed_sql() -> str:
    z = "cast(floor(log2(greatest(size, 1))) as integer)"
    tilt = lambda mu: f"least({MOST}.0::double, exp(x + {mu} * c.z))"
    total = lambda e: f"list_sum([{e} for c in cells])"
    free = lambda mu: f"case when {tilt(mu)} < {MOST} then c.words * {tilt(mu)} else 0 end"
    rounds = []
    for k in range(ROUNDS + 1):
        mu = "(select mu from first_mu)" if k == 0 else f"(select mu from mu_{k})"
        rounds.append(f"""
steps_{k} as (
  select source, cells, target, m.mu, 0 as i, -{WIDEST}::double as lo, {WIDEST}::double as hi, 0::double as x
  from plan, (select {mu} as mu) m where target < cap and target > 0
  union all
  select source, cells, target, mu, i + 1, lo2, hi2, case when newton > lo2 and newton < hi2 then newton else (lo2 + hi2) / 2 end
  from (
    select *, case when got <= target then x else lo end as lo2, case when got <= target then hi else x end as hi2,
           case when slope > 0 then x + (target - got) / slope end as newton
    from (select *, {total("c.words * " + tilt("mu"))} as got, {total(free("mu"))} as slope from steps_{k} where i < {STEPS}) s) t),
solved_{k} as (select source, cells, mu, x from steps_{k} where i = {STEPS})""")
        if k < ROUNDS:
            rounds.append(f"""
mu_{k + 1} as (
  select case when coalesce(s, 0) <= 0 then {mu} else round(greatest(-{STEEPEST}::double, least({STEEPEST}::double, {mu} + ((select wanted from first_mu) - m) / s)), 9) end as mu
  from (
    select sum(m) as m, sum(case when a > 0 then q - b * b / a else 0 end) as s
    from (select {total("c.words * " + tilt("mu") + " * c.z")} as m, {total(free("mu"))} as a,
                 {total("(" + free("mu") + ") * c.z")} as b, {total("(" + free("mu") + ") * c.z * c.z")} as q from solved_{k}) e) f)""")
    last = f"coalesce((select mu from mu_{ROUNDS}), 0)"
    return rf"""
with recursive sizes as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as h
  from {{documents}}),
by_class as (select source, {z} as z, cast(sum(size) as double) as words from sizes group by source, 2),
by_source as (
  select source, sum(words) as source_size, list(struct_pack(z := z, words := words) order by z) as cells, sum(words) * {MOST}.0::double as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {WEIGHTS[0]}.0::double when 1 then {WEIGHTS[1]}.0::double else {WEIGHTS[2]}.0::double end as weight
  from by_class group by source),
ordered as (
  select *, sum(source_size) over () * {SHARE}::double as every, sum(weight) over () as weights,
         coalesce(sum(cap) over w, 0) as used, coalesce(sum(weight) over w, 0) as gone
  from by_source
  window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (every - used) / (weights - gone) as level from ordered),
chosen as (select min(struct_pack(a := cap / weight, l := level)).l as level from levels where weight * level < cap),
plan as materialized (select o.source, o.source_size, o.cells, o.cap, least(o.cap, coalesce(o.weight * c.level, o.cap)) as target from ordered o, chosen c),
first_mu as materialized (
  select 0::double as mu, sum({total("c.words * c.z")}) / nullif(sum(source_size), 0) * sum(target)
         - sum(case when target >= cap and target > 0 then {total("c.words * c.z")} * {MOST} else 0 end) as wanted
  from plan),{",".join(rounds)},
rated as (
  select s.doc_id, s.source, s.size, s.h, cast(p.source_size as bigint) as source_size, p.target,
         case when s.size = 0 then 0 else round(case when p.target <= 0 then 0 when p.target >= p.cap then {MOST}
              else least({MOST}.0::double, exp(v.x + {last} * floor(log2(greatest(s.size, 1))))) end, 9) end as rate,
         cast(('0x' || substr(s.h, 1, 8)) as bigint) / 4294967296.0::double as chance
  from sizes s join plan p on s.source is not distinct from p.source left join solved_{ROUNDS} v on s.source is not distinct from v.source),
turned as (
  select *, floor(rate) as whole, case when size = 0 then 2 + chance when rate = floor(rate) then 1 + chance
         else greatest(chance, 1e-9::double) / (greatest(chance, 1e-9::double) + (rate - floor(rate))) end as turn
  from rated),
run as (
  select *, floor(target + 1e-6) - sum(whole * size) over (partition by source) as rest,
         coalesce(sum(size) over (partition by source order by turn, h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from turned)
select doc_id, size, source_size, target,
       cast(least(whole * size + greatest(0, least(size, rest - ahead)), size * {MOST}) as bigint) as taken
from run
"""


#: The rows of ``mixed`` in DuckDB's SQL over ``documents``; {documents} may be any such relation.
MIXED_SQL = _mixed_sql()
