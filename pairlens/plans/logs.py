"""Queries on event logs and fact tables: group rates, budgets, terminal rows, joins in time and space."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.functions.nulls import rate
from pairlens.operators import joins, summaries
from pairlens.operators.nearest import nearest_place
from pairlens.operators.pairs import rounded
from pairlens.operators.quantiles import quantiles
from pairlens.operators.resample import DRAWS, bootstrap_means, intervals, means_sql
from pairlens.plans.views import literals, sql_bucket, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def micros(ts: str):
    """Microseconds since 1970 of a timestamp with or without time zone, by its own clock."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


@query("""select l_returnflag as attack, l_linestatus as defense, count(*) as n, round(count(*) filter (l_discount > 0.05)::double / count(*), 9) as success_rate,
        round(count(*) filter (l_tax < 0.03 and l_discount > 0.05)::double / nullif(count(*) filter (l_discount > 0.05), 0), 9) as conditional_rate, round(avg(l_quantity), 9) as mean_quality from lineitem group by all""")
def group_rates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    hit = F.col("l_discount") > 0.05
    return rounded(li.groupBy(F.col("l_returnflag").alias("attack"), F.col("l_linestatus").alias("defense")).agg(
        F.count("*").alias("n"), rate(F.count_if(hit), F.count("*")).alias("success_rate"),
        rate(F.count_if(hit & (F.col("l_tax") < 0.03)), F.count_if(hit)).alias("conditional_rate"), F.avg("l_quantity").alias("mean_quality"),
    ))


@query("""with j as (select o_orderpriority as severity, o_orderstatus as family, l_returnflag as scenario, l_discount > 0.05 as hit from lineitem join orders on l_orderkey = o_orderkey)
    select severity, family, scenario, count(*) as n, count(*) filter (hit) as k, round(count(*) filter (hit)::double / count(*), 9) as rate from j
    group by grouping sets ((severity), (family), (scenario), (scenario, severity))""")
def rollup_rates(spark, sf_dir):
    """Four groupings in one pass over the joined rows."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("family"), F.col("l_returnflag").alias("scenario"), (F.col("l_discount") > 0.05).alias("hit"))
    g = j.groupingSets([["severity"], ["family"], ["scenario"], ["scenario", "severity"]], "severity", "family", "scenario")
    return rounded(g.agg(F.count("*").alias("n"), F.count_if("hit").alias("k"), rate(F.count_if(F.col("hit")), F.count("*")).alias("rate")))


@query("""with f as (select l_orderkey, min(l_linenumber) filter (l_discount > 0.07) as first from lineitem group by all), b as (select *, unnest([1, 2, 4, 7]) as budget from f)
    select budget::bigint as budget, count(*) as items, count(*) filter (first <= budget) as successes, round(avg(least(coalesce(first, budget), budget)), 9) as mean_queries from b group by budget""")
def success_at_budget(spark, sf_dir):
    return rounded(summaries.success_budgets(table(spark, sf_dir, "lineitem"), [], "l_orderkey", "l_linenumber", F.col("l_discount") > 0.07, [1, 2, 4, 7]))


TERMINAL = """t as (select l_orderkey, min(l_linenumber) filter (l_discount > 0.08) as first_success, max(l_linenumber) as queries, list(l_returnflag order by l_linenumber, l_returnflag) as feedback from lineitem group by all),
    terminal as (select *, case when first_success is not null then 'success' when queries >= 6 then 'budget_exhausted' else 'stopped' end as outcome from t)"""


def terminal(spark, sf_dir):
    return summaries.terminal_rows(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_discount") > 0.08, "l_returnflag", 6)


@query(f"with {TERMINAL} select l_orderkey, first_success::bigint as first_success, queries::bigint as queries, array_to_string(feedback, ',') as feedback, outcome from terminal")
def terminal_outcomes(spark, sf_dir):
    t = terminal(spark, sf_dir)
    return t.select("l_orderkey", F.col("first_success").cast("long").alias("first_success"), F.col("queries").cast("long").alias("queries"), F.array_join("feedback", ",").alias("feedback"), "outcome")


@query(f"""with {TERMINAL}, k as (select outcome, feedback, unnest([1, 3]) as k from terminal)
    select outcome, k::bigint as k, count(*) as items, count(*) filter (list_contains(feedback[1:k], 'R')) as with_feedback, sum(8 - len(feedback))::bigint as unused_budget from k group by all""")
def terminal_summary(spark, sf_dir):
    """Histogram of outcomes with feedback in the first k rounds and the budget left unused."""
    t = terminal(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3))))
    return t.groupBy("outcome", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("items"), F.count_if(F.exists(F.slice("feedback", F.lit(1), F.col("k")), lambda x: x == "R")).alias("with_feedback"), F.sum(8 - F.size("feedback")).alias("unused_budget"))


@query("""select event_type, count(value) as count, round(min(value), 9) as minimum, round(max(value), 9) as maximum, round(avg(value), 9) as mean, round(median(value), 9) as median, count(distinct user_id) as users from events group by event_type""")
def distribution_block(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    block = e.groupBy("event_type").agg(*summaries.distribution("value"), F.count_distinct("user_id").alias("users"))
    middle = quantiles(e, ["event_type"], "value", {"median": (0.5, "linear")}).select(F.col("event_type").alias("__type"), "median")
    return rounded(block.join(middle, F.col("event_type").eqNullSafe(F.col("__type")), "left").drop("__type"))


@query("""select l_orderkey, max(l_extendedprice) as l_extendedprice, arg_max(l_partkey, struct_pack(a := l_extendedprice, b := -l_linenumber)) as l_partkey, round(max(l_quantity) - min(l_quantity), 9) as spread,
        array_to_string(list_sort(list(distinct l_returnflag)), ',') as labels from lineitem group by l_orderkey""")
def largest_in_group(spark, sf_dir):
    """The part of the dearest line of each order (first line wins ties), the spread of quantities, the label set."""
    li = table(spark, sf_dir, "lineitem")
    extra = li.groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("labels"))
    return rounded(summaries.largest(li, ["l_orderkey"], "l_extendedprice", "l_linenumber", "l_partkey").join(extra, "l_orderkey"))


@query("""with r as (select l_orderkey, max(l_quantity) - min(l_quantity) as spread from lineitem group by all) select count(*) as items, round(avg(spread), 9) as mean, round(median(spread), 9) as median, max(spread) as most from r""")
def within_item_range(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"))
    middle = quantiles(r, [], "spread", {"median": (0.5, "linear")}).select("median")
    return rounded(r.agg(F.count("*").alias("items"), F.avg("spread").alias("mean"), F.max("spread").alias("most")).join(F.broadcast(middle), F.lit(True), "left"))


@query("""with p as (select l_returnflag || '-' || l_linestatus || '-' || (l_linenumber % 2) as policy, l_orderkey, (l_discount > 0.05)::int as ok from lineitem),
        f as (select 'flag' as factor, split_part(policy, '-', 1) as level, l_orderkey, ok from p union all select 'status', split_part(policy, '-', 2), l_orderkey, ok from p union all select 'parity', split_part(policy, '-', 3), l_orderkey, ok from p),
        m as (select factor, level, l_orderkey, avg(ok) as m from f group by all)
    select factor, level, count(*) as items, round(avg(m), 9) as mean from m group by all""")
def factor_marginals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("policy"), "l_orderkey", (F.col("l_discount") > 0.05).cast("int").alias("ok"))
    return rounded(summaries.factor_means(li, "policy", ["flag", "status", "parity"], "l_orderkey", "ok"))


@query("""with p as (select l_shipdate, l_returnflag || l_linestatus || l_linenumber as policy, l_orderkey % 3 as model, (l_discount > 0.05)::int as asr, (l_tax > 0.04)::int as grounded, l_quantity / 50 as area from lineitem),
        m as (select policy, model, avg(asr) as a, avg(grounded) as g, avg(area) as s from p group by all), t as (select policy, avg(a) as asr, avg(g) as grounded, avg(s) as area from m group by policy)
    select policy, round(asr + 0.10 * grounded - 0.05 * area, 9) as score from t where grounded >= 0.4 order by score desc, policy limit 1""")
def best_policy(spark, sf_dir):
    """Ensemble score of policies, means within models first, gated and ranked."""
    p = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("policy"), (F.col("l_orderkey") % 3).alias("model"), (F.col("l_discount") > 0.05).cast("int").alias("asr"), (F.col("l_tax") > 0.04).cast("int").alias("grounded"), (F.col("l_quantity") / 50).alias("area"))
    t = p.groupBy("policy", "model").agg(F.avg("asr").alias("asr"), F.avg("grounded").alias("grounded"), F.avg("area").alias("area")).groupBy("policy").agg(*[F.avg(c).alias(c) for c in ("asr", "grounded", "area")])
    score = F.round(F.col("asr") + 0.10 * F.col("grounded") - 0.05 * F.col("area"), 9)
    return t.where("grounded >= 0.4").select("policy", score.alias("score")).orderBy(F.desc("score"), "policy").limit(1)


@query("""with c as (select l_orderkey, l_linenumber, l_suppkey % 4 as attempt, bool_and(l_tax < 0.07) over (partition by l_orderkey, l_suppkey % 4) as complete from lineitem), a as (select distinct l_orderkey, attempt, complete from c)
    select l_orderkey, max(attempt) as attempt from a where complete group by l_orderkey""")
def latest_complete_attempt(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("attempt")).agg(F.bool_and(F.col("l_tax") < 0.07).alias("complete"))
    return summaries.latest_complete(a, "l_orderkey", "attempt", F.col("complete")).select("l_orderkey", "attempt")


@query("""with o as (select o_orderkey, o_totalprice, o_orderdate from orders), a as (select o_orderkey from o order by o_totalprice desc, o_orderkey limit 1),
        b as (select o_orderkey from o where o_orderkey not in (from a) order by o_orderdate, o_orderkey limit 1), c as (select o_orderkey from o where o_orderkey not in (from a) and o_orderkey not in (from b) order by o_totalprice, o_orderkey limit 1)
    select 0 as criterion, o_orderkey from a union all select 1, o_orderkey from b union all select 2, o_orderkey from c""")
def exemplar_choice(spark, sf_dir):
    return summaries.exemplars(table(spark, sf_dir, "orders"), "o_orderkey", [[F.desc("o_totalprice"), "o_orderkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_orderkey"]])


@query("""select l_returnflag as arm, count(*) as calls, count(*) filter (l_tax = 0.08) as errors, round(avg(l_quantity) filter (l_tax <> 0.08), 9) as mean_tokens, round(avg(l_extendedprice) filter (l_tax <> 0.08), 6) as mean_cost,
        count(*) filter (l_tax <> 0.08 and l_quantity >= 49) as cap_hits, count(*) filter (l_linestatus = 'O' and l_tax <> 0.08) as abstained from lineitem group by all""")
def call_costs(spark, sf_dir):
    """Means over calls without error, cap hits and abstentions."""
    ok = F.col("l_tax") != 0.08
    return rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(
        F.count("*").alias("calls"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("l_quantity"))).alias("mean_tokens"), F.round(F.avg(F.when(ok, F.col("l_extendedprice"))), 6).alias("mean_cost"),
        F.count_if(ok & (F.col("l_quantity") >= 49)).alias("cap_hits"), F.count_if(ok & (F.col("l_linestatus") == "O")).alias("abstained"),
    ))


@query("""with d as (select distinct o_orderstatus as a, o_orderpriority as b from orders), g as (select a, b from (select distinct a from d) x cross join (select distinct b from d) y) select a, b from g anti join d using (a, b)
    union all select 'total', count(*)::varchar from d""")
def matrix_completeness(spark, sf_dir):
    """Cells of the full product that no row fills, and the number filled."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).distinct()
    grid = d.select("a").distinct().crossJoin(F.broadcast(d.select("b").distinct()))
    return grid.join(d, ["a", "b"], "left_anti").unionByName(d.agg(F.lit("total").alias("a"), F.count("*").cast("string").alias("b")))


@query("""with p as (select event_id, user_id, (epoch_us(ts) // 60000000)::bigint as m from events where event_type = 'purchase'), v as (select event_id as view_id, user_id, (epoch_us(ts) // 60000000)::bigint as m2 from events where event_type = 'view'),
        j as (select *, row_number() over (partition by event_id order by abs(m2 - m), m2, view_id) as r from p join v using (user_id) where abs(m2 - m) <= 600) select event_id, view_id, m2 - m as minutes from j where r = 1""")
def nearest_event(spark, sf_dir):
    """For each purchase the user's nearest view within 600 minutes; the earlier wins ties."""
    e = table(spark, sf_dir, "events").withColumn("m", F.floor(micros("ts") / 60_000_000))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "m", F.col("event_id").alias("__id"))
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("m").alias("m2"))
    return joins.nearest_in_time(p, v, ["user_id"], "m", "m2", 600, ["view_id"]).select("event_id", "view_id", (F.col("m2") - F.col("m")).alias("minutes"))


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts, max(value) as value from events where event_type = 'click' group by all)
    select p.event_id, v.value as last_value from p asof left join v on p.user_id = v.user_id and v.ts <= p.ts""")
def latest_event_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p, v = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", F.col("ts").alias("t2"), "value")
    return joins.latest_before(p, v, ["user_id"], "ts", "t2", "value").select("event_id", "last_value")


@query("""with s as (select s_suppkey, s_nationkey, (s_suppkey * 7 % 181 - 90)::double as lat, (s_suppkey * 13 % 361 - 180)::double as lon from supplier), c as (select c_custkey, c_nationkey, (c_custkey * 11 % 181 - 90)::double as lat, (c_custkey * 17 % 361 - 180)::double as lon from customer),
        d as (select c_custkey, s_suppkey, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) as km from c join s on c_nationkey = s_nationkey)
    select c_custkey, round(min(km), 4) as km from d group by c_custkey""")
def nearest_station(spark, sf_dir):
    """The distance of the nearest supplier of a customer's nation, anywhere on the sphere, by a grid of cubes."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") * 7 % 181 - 90).cast("double").alias("lat2"), (F.col("s_suppkey") * 13 % 361 - 180).cast("double").alias("lon2"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 11 % 181 - 90).cast("double").alias("lat"), (F.col("c_custkey") * 17 % 361 - 180).cast("double").alias("lon"))
    return nearest_place(c, s, ["nation"], "lat", "lon", "lat2", "lon2", "s_suppkey").select("c_custkey", F.round("km", 4).alias("km"))


@query("""with a as (select user_id, event_type, count(*) as n from events group by all) select user_id from a group by user_id having count(distinct event_type) = 5""")
def ids_in_every_source(spark, sf_dir):
    return joins.in_every(table(spark, sf_dir, "events"), "user_id", "event_type", 5)


@query("""with e as (select event_id, user_id, (epoch_us(ts) // 3600000000)::bigint as hour, ts from events where event_type <> 'error' and value > 20), r as (select *, row_number() over (partition by user_id, hour order by ts, event_id) as n from e) select event_id, user_id, hour from r where n = 1""")
def first_accepted_rows(spark, sf_dir):
    """The first row of each user and hour among those that pass every filter."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.floor(micros("ts") / 3_600_000_000))
    return joins.first_accepted(e, (F.col("event_type") != "error") & (F.col("value") > 20), ["user_id", "hour"], ["ts", "event_id"]).select("event_id", "user_id", "hour")


@query("""with e as (select event_id, case when event_type = 'error' then 'license' when value < 10 then 'restricted' when extract(hour from ts) not between 7 and 18 then 'daylight' when user_id % 11 = 0 then 'location' else 'accepted' end as reason from events)
    select reason, count(*) as rows from e group by all""")
def first_failing_reason(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reason = F.when(F.col("event_type") == "error", "license").when(F.col("value") < 10, "restricted").when(~F.hour("ts").between(7, 18), "daylight").when(F.col("user_id") % 11 == 0, "location").otherwise("accepted")
    return e.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""with m as (select {sql_bucket(4, "'man'", "l_orderkey", "l_linenumber")} as manifest, l_partkey as id from lineitem), d as (select distinct manifest, id from m), f as (select *, min(manifest) over (partition by id) as first from d)
    select manifest, count(*) as ids, count(*) filter (first < manifest) as seen_before from f group by manifest""")
def overlap_with_prior(spark, sf_dir):
    """Ids of each manifest that an earlier one holds."""
    li = table(spark, sf_dir, "lineitem")
    d = li.select(H.bucket(4, "man", F.col("l_orderkey"), F.col("l_linenumber")).alias("manifest"), F.col("l_partkey").alias("id")).distinct()
    f = d.withColumn("first", F.min("manifest").over(Window.partitionBy("id")))
    return f.groupBy("manifest").agg(F.count("*").alias("ids"), F.count_if(F.col("first") < F.col("manifest")).alias("seen_before"))


@query("""with p as (select l_orderkey, max(l_quantity) filter (l_returnflag = 'A') as moderate, max(l_quantity) filter (l_returnflag = 'R') as extreme from lineitem group by all)
    select count(*) as paired, round(avg(extreme - moderate), 9) as mean_gain, count(*) filter (abs(extreme - moderate) <= greatest(1e-9 * greatest(abs(extreme), abs(moderate)), 5)) as captured from p where moderate is not null and extreme is not null""")
def complete_case_pairs(spark, sf_dir):
    """Items with both severities, their mean gain, and how many lie within an absolute tolerance."""
    q = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q("A").alias("moderate"), q("R").alias("extreme")).dropna()
    d = F.abs(F.col("extreme") - F.col("moderate"))
    close = d <= F.greatest(1e-9 * F.greatest(F.abs("extreme"), F.abs("moderate")), F.lit(5.0))
    return rounded(p.agg(F.count("*").alias("paired"), F.avg(F.col("extreme") - F.col("moderate")).alias("mean_gain"), F.count_if(close).alias("captured")))


@query("""with c as (select * from (values ('low', 'A', 1), ('low', 'N', 2), ('high', 'R', 3), ('high', 'A', 4)) t(severity, label, claim))
    select l_orderkey, l_linenumber, severity, claim, l_quantity from lineitem join c on l_returnflag = label where severity = 'high'""")
def claims_lookup(spark, sf_dir):
    """One row a line and matching claim of a small dimension."""
    c = F.broadcast(spark.createDataFrame([("low", "A", 1), ("low", "N", 2), ("high", "R", 3), ("high", "A", 4)], "severity string, label string, claim int"))
    return table(spark, sf_dir, "lineitem").join(c, F.col("l_returnflag") == F.col("label")).where("severity = 'high'").select("l_orderkey", "l_linenumber", "severity", "claim", "l_quantity")


@query(f"""with m as ({means_sql("documents", "lang", "doc_id", "n_chars::double", 20260914)})
    select lang as stratum, count(*) as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg(m), 6) as mean from m group by lang""")
def stratified_bootstrap(spark, sf_dir):
    """Bootstrap of means within strata; draws come from hashes, so any engine draws the same."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("stratum"), "doc_id", F.col("n_chars").cast("double").alias("v"))
    return intervals(bootstrap_means(d, ["stratum"], "doc_id", "v", DRAWS, 20260914), ["stratum"])
