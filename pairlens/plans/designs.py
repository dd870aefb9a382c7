"""Queries on designs and their checks: splits, lattices, pairings, resampled contrasts, replay and order audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.functions import text as T
from pairlens.functions.nulls import is_value
from pairlens.operators import audits, digests, pairs, ranking, resample
from pairlens.plans.paired import DID, did
from pairlens.plans.selecting import OBSERVED, observed
from pairlens.plans.views import RUNS3, RUNS6, literals, runs3, runs6, sql_bucket, sql_list, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""with f as (select source, lang, min(doc_id) as first from documents group by all), r as (select *, row_number() over (partition by lang order by first) - 1 as k from f)
    select source, lang, first, case when k % 2 = 0 then 'even' else 'odd' end as half from r""")
def parity_split(spark, sf_dir):
    """Distinct values in order of first appearance, split by parity of their place."""
    f = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    r = ranking.ranked(f, ["first"], ["lang"])
    return r.select("source", "lang", "first", F.when(F.col("rank") % 2 == 0, "even").otherwise("odd").alias("half"))


@query(f"""with {RUNS6} select distinct condition, regexp_extract(condition, '^(.*)_(true|false)$', 1) as cue, regexp_extract(condition, '^(.*)_(true|false)$', 2) as truth, cue || ' / ' || truth as shown from runs6""")
def condition_parts(spark, sf_dir):
    p = "^(.*)_(true|false)$"
    c = runs6(spark, sf_dir).select("condition").distinct()
    return c.select("condition", F.regexp_extract("condition", p, 1).alias("cue"), F.regexp_extract("condition", p, 2).alias("truth")).withColumn("shown", F.concat_ws(" / ", "cue", "truth"))


@query(f"""select item_id, concat_ws('-', a, b, c) as policy, a, b, c from benchmark, {sql_list("a", ["s", "m", "l"])} x, {sql_list("b", ["n", "e", "w", "x"])} y, {sql_list("c", ["p", "q"])} z""")
def policy_lattice(spark, sf_dir):
    """Every benchmark item under the full product of three fixed factor lists."""
    factors = [F.transform(F.array(*map(F.lit, x)), lambda v: v) for x in (["s", "m", "l"], ["n", "e", "w", "x"], ["p", "q"])]
    g = table(spark, sf_dir, "benchmark").select("item_id")
    for name, values in zip("abc", factors, strict=True):
        g = g.withColumn(name, F.explode(values))
    return g.select("item_id", F.concat_ws("-", "a", "b", "c").alias("policy"), "a", "b", "c")


@query("""with u as (select doc_id, sha256(text) as h from documents where source in ('src0', 'src1')) select doc_id from documents d where source not in ('src0', 'src1')
    and not exists (select 1 from u where u.doc_id = d.doc_id) and not exists (select 1 from u where u.h = sha256(d.text))""")
def fresh_items(spark, sf_dir):
    """Items that earlier sets hold neither by id nor by content."""
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    used = d.where(F.col("source").isin("src0", "src1"))
    return d.where(~F.col("source").isin("src0", "src1")).join(used.select("doc_id"), "doc_id", "left_anti").join(used.select("h"), "h", "left_anti").select("doc_id")


@query(f"""with {RUNS3}, b as (select model, item_id, decide as clean from runs3 where condition = 'record_true') select r.model, r.condition, count(*) as n, count(*) filter (decide is distinct from clean) as changed
    from runs3 r join b using (model, item_id) where r.condition <> 'record_true' group by all""")
def baseline_pairs(spark, sf_dir):
    """Every attacked row next to its item's clean row, and how many answers changed (null-safe)."""
    r = runs3(spark, sf_dir)
    base = r.where("condition = 'record_true'").select("model", "item_id", F.col("decide").alias("clean"))
    j = r.where("condition <> 'record_true'").join(base, ["model", "item_id"])
    return j.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_if(~F.col("decide").eqNullSafe(F.col("clean"))).alias("changed"))


@query(f"""with {RUNS3}, a as (select item_id, condition, decide from runs3 where model = 'm0'), b as (select item_id, condition, decide from runs3 where model = 'm1'), c as (select item_id, condition, decide from runs3 where model = 'm2')
    select condition, count(*) as n, count(*) filter (a.decide is not distinct from b.decide and b.decide is not distinct from c.decide) as unanimous, count(*) filter (a.decide is distinct from c.decide and a.decide is not distinct from b.decide) as third_differs
    from a join b using (item_id, condition) join c using (item_id, condition) group by condition""")
def three_source_agreement(spark, sf_dir):
    """Three logs of the same items in one pivot."""
    w = pairs.pivot_conditions(runs3(spark, sf_dir).where("model <> 'm3'"), ["item_id", "condition"], "model", ["m0", "m1", "m2"], ["decide"])
    a, b, c = (F.col(f"decide_m{k}") for k in range(3))
    return w.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(a.eqNullSafe(b) & b.eqNullSafe(c)).alias("unanimous"), F.count_if(a.eqNullSafe(b) & ~a.eqNullSafe(c)).alias("third_differs"))


@query(f"""with {RUNS6} select model, cue, count(*) filter (read_match and knows) as grounded, count(*) filter (read_match and knows and decide = 'consistent') as captured from runs6 where truth = 'false' group by all""")
def grounded_capture(spark, sf_dir):
    """Answers taken over by a false record although it was read and the fact was known."""
    r = runs6(spark, sf_dir).where("truth = 'false'")
    ok = F.coalesce(F.col("read_match") & F.col("knows"), F.lit(False))
    return r.groupBy("model", "cue").agg(F.count_if(ok).alias("grounded"), F.count_if(ok & is_value("decide", "consistent")).alias("captured"))


@query("""with c as (select l_returnflag as policy, l_orderkey, l_linenumber as k, l_discount > 0.07 as hit, l_linestatus from lineitem), b as (select *, unnest([2, 4, 6]) as budget from c)
    select policy, budget::bigint as budget, count(*) filter (k <= budget) as calls, count(*) filter (k <= budget and hit) as hits, count(*) filter (k <= budget and l_linestatus = 'O') as open_calls, count(distinct l_orderkey) filter (k <= budget and hit) as items from b group by all""")
def budget_curve(spark, sf_dir):
    """Calls, hits and statuses of each policy within a budget."""
    b = table(spark, sf_dir, "lineitem").withColumn("budget", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))))
    inside, hit = F.col("l_linenumber") <= F.col("budget"), F.col("l_discount") > 0.07
    return b.groupBy(F.col("l_returnflag").alias("policy"), F.col("budget").cast("long").alias("budget")).agg(F.count_if(inside).alias("calls"), F.count_if(inside & hit).alias("hits"), F.count_if(inside & (F.col("l_linestatus") == "O")).alias("open_calls"), F.count_distinct(F.when(inside & hit, F.col("l_orderkey"))).alias("items"))


@query(f"""with {DID}, m as ({resample.means_sql("did", "model", "item_id", "d::double", 7)})
    select model, count(*) as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg(m), 6) as mean from m group by model""")
def interaction_interval(spark, sf_dir):
    """Paired bootstrap interval of item-level differences from -2 to 2."""
    d = did(spark, sf_dir).withColumn("zero", F.lit(0))
    return resample.paired_difference(d, ["model"], "item_id", "zero", "d", resample.DRAWS, 7)


@query(f"""with {RUNS6}, c_p as (select model, family, sum((coalesce(decide = gold, false))::int)::double as s, count(*) as k from runs6 group by all), c_r as (select *, row_number() over (partition by model order by family) - 1 as pos, count(*) over (partition by model) as n from c_p),
        c_d as (select draw, model, x % n as pick from {resample.scattered_sql(f"(select * from c_r, (select unnest(range({resample.DRAWS})) as draw))", "draw", "pos", 11)}),
        c_m as (select d.draw, d.model, sum(s) / sum(k) as m from c_d d join c_r r on r.model = d.model and r.pos = d.pick group by all)
    select model, count(*) as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg(m), 6) as mean from c_m group by model""")
def cluster_bootstrap(spark, sf_dir):
    """Bootstrap interval of accuracy when whole families are drawn."""
    r = runs6(spark, sf_dir).withColumn("ok", F.coalesce(F.col("decide") == F.col("gold"), F.lit(False)).cast("int"))
    return resample.cluster_means(r, ["model"], "family", "ok", resample.DRAWS, 11)


@query(f"""with s as (select doc_id, method, sha256(concat_ws(':', 'order', doc_id, method)) as h from documents, {sql_list("method", ["a", "b", "c"])} m) select doc_id, method, row_number() over (partition by doc_id order by h) as place from s""")
def method_schedule(spark, sf_dir):
    """The order of methods for each item, by hash."""
    s = table(spark, sf_dir, "documents").select("doc_id").crossJoin(literals(spark, "method", ["a", "b", "c"]))
    return ranking.ranked(s.withColumn("h", H.keyed("order", F.col("doc_id"), F.col("method"))), ["h"], ["doc_id"]).select("doc_id", "method", (F.col("rank") + 1).cast("long").alias("place"))


@query(f"""with r as (select doc_id, annotator, sha256(concat_ws(':', 'view', annotator, doc_id)) as h, sha256(concat_ws(':', 'again', annotator, doc_id)) as h2 from documents, {sql_list("annotator", ["a1", "a2"])} a),
        d as (select *, row_number() over (partition by annotator order by h) as k, count(*) over (partition by annotator) as n from r), u as (select annotator, doc_id, h, 0 as copy from d union all select annotator, doc_id, h2, 1 from d where k <= n // 10)
    select annotator, doc_id, copy, row_number() over (partition by annotator order by h) as place from u""")
def attention_checks(spark, sf_dir):
    """A tenth of each annotator's rows twice, all in hash order."""
    a = table(spark, sf_dir, "documents").select("doc_id").crossJoin(literals(spark, "annotator", ["a1", "a2"]))
    a = a.withColumns({"h": H.keyed("view", F.col("annotator"), F.col("doc_id")), "h2": H.keyed("again", F.col("annotator"), F.col("doc_id"))})
    w = Window.partitionBy("annotator")
    d = a.withColumns({"k": F.row_number().over(w.orderBy("h")), "n": F.count("*").over(w)})
    both = d.select("annotator", "doc_id", "h", F.lit(0).alias("copy")).unionByName(d.where(F.col("k") <= F.floor(F.col("n") / 10)).select("annotator", "doc_id", F.col("h2").alias("h"), F.lit(1).alias("copy")))
    return both.select("annotator", "doc_id", "copy", F.row_number().over(w.orderBy("h")).cast("long").alias("place"))


@query(f"""with {OBSERVED}, part as (select *, {sql_bucket(3, "'shard'", "item_id")} as shard from observed), u as (select model, item_id, condition, count(*) as n, count(distinct shard) as shards from part group by all)
    select count(*) as keys, count(*) filter (n > 1) as doubled, count(*) filter (shards > 1) as across_shards, (select count(*) from runs3) - count(*) as missing from u""")
def disjoint_union(spark, sf_dir):
    """Shards put together by key: doubled keys, keys in several shards, and what the union lacks."""
    o = observed(spark, sf_dir).withColumn("shard", H.bucket(3, "shard", F.col("item_id")))
    u = o.groupBy("model", "item_id", "condition").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards"))
    total = runs3(spark, sf_dir).agg(F.count("*").alias("total"))
    s = u.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("doubled"), F.count_if(F.col("shards") > 1).alias("across_shards"))
    return s.crossJoin(F.broadcast(total)).select("keys", "doubled", "across_shards", (F.col("total") - F.col("keys")).alias("missing"))


@query(f"""with {RUNS6}, s as (select *, case when {sql_bucket(200, "'replay'", "model", "item_id", "condition")} = 0 then not coalesce(decide = gold, false) else coalesce(decide = gold, false) end as stored from runs6)
    select 'replay' as rule, concat_ws('|', model, item_id, condition) as key, stored::varchar as detail from s where stored is distinct from coalesce(decide = gold, false)""")
def replay_audit(spark, sf_dir):
    """A stored derived column against the same column computed again."""
    right = F.coalesce(F.col("decide") == F.col("gold"), F.lit(False))
    bad = H.bucket(200, "replay", F.col("model"), F.col("item_id"), F.col("condition")) == 0
    s = runs6(spark, sf_dir).withColumn("stored", F.when(bad, ~right).otherwise(right))
    return s.where(~F.col("stored").eqNullSafe(right)).select(F.lit("replay").alias("rule"), F.concat_ws("|", "model", F.col("item_id").cast("string"), "condition").alias("key"), F.col("stored").cast("string").alias("detail"))


@query("""with f as (select user_id, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) as frozen from events where event_type = 'signup' group by all), c as (select event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as started from events where event_type = 'purchase')
    select event_id, started, frozen from c join f using (user_id) where started < frozen""")
def calls_before_freeze(spark, sf_dir):
    """Calls whose ISO timestamp sorts before the freeze time of their request."""
    e = table(spark, sf_dir, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    f = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("iso").alias("frozen"))
    c = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("iso").alias("started"))
    return c.join(f, "user_id").where("started < frozen").select("event_id", "started", "frozen")


@query("""with r as (select l_orderkey as item, l_suppkey % 3 as annotator from lineitem), c as (select item, annotator, count(*) as n from r group by all), i as (select item, count(*) as k, max(n) as most from c group by all)
    select 'annotators' as rule, item::varchar as key, k::varchar as detail from i where k < 2 union all select 'twice', item::varchar, most::varchar from i where most > 1""")
def annotator_audit(spark, sf_dir):
    """Items with fewer than two annotators, and items that one annotator rated twice."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 3).alias("annotator")).agg(F.count("*").alias("n"))
    i = c.groupBy("item").agg(F.count("*").alias("k"), F.max("n").alias("most"))
    rules = F.array_compact(F.array(F.when(F.col("k") < 2, F.struct(F.lit("annotators").alias("rule"), F.col("k").cast("string").alias("detail"))), F.when(F.col("most") > 1, F.struct(F.lit("twice").alias("rule"), F.col("most").cast("string").alias("detail")))))
    return i.withColumn("x", F.explode(rules)).select("x.rule", F.col("item").cast("string").alias("key"), "x.detail")


@query("""with s as (select p_partkey, p_size::double as truth, p_size + 2.0 as subtle, p_size + 10.0 as moderate, case when p_size < 25 then 60.0 else p_size + 5.0 end as extreme from part)
    select p_partkey, abs(subtle - truth) < abs(moderate - truth) and abs(moderate - truth) < abs(extreme - truth) as monotone, least(abs(subtle - truth), abs(moderate - truth), abs(extreme - truth)) > 0.05 as distinct_values from s""")
def severity_order(spark, sf_dir):
    """Counterfactual values must move away from the truth with severity and differ from it."""
    s = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("t"))
    a, b, c = F.lit(2.0), F.lit(10.0), F.when(F.col("t") < 25, F.abs(60.0 - F.col("t"))).otherwise(F.lit(5.0))
    return s.select("p_partkey", ((a < b) & (b < c)).alias("monotone"), (F.least(a, b, c) > 0.05).alias("distinct_values"))


@query("""with b as (select l_orderkey, l_linenumber, l_quantity as x0, l_quantity + 10 as x1, l_tax * 100 as y0, l_tax * 100 + 6 as y1 from lineitem)
    select l_orderkey, l_linenumber, round(greatest(0, least(x1, 40) - greatest(x0, 20)) * greatest(0, least(y1, 10) - greatest(y0, 2)) / ((x1 - x0) * (y1 - y0)), 9) as inside from b""")
def box_overlap(spark, sf_dir):
    """Share of each box inside a fixed one."""
    x0, y0 = F.col("l_quantity"), F.col("l_tax") * 100
    x1, y1 = x0 + 10, y0 + 6
    side = lambda lo, hi, a, b: F.greatest(F.lit(0.0), F.least(hi, F.lit(float(b))) - F.greatest(lo, F.lit(float(a))))
    return pairs.rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (side(x0, x1, 20, 40) * side(y0, y1, 2, 10) / ((x1 - x0) * (y1 - y0))).alias("inside")))


@query(f"""with {RUNS6} select distinct truth, polarity, case when (truth = 'true') = (polarity = 'direct') then 'yes' else 'no' end as gold_said, case when (truth = 'true') = (polarity = 'direct') then 'no' else 'yes' end as target_said from runs6""")
def decision_semantics(spark, sf_dir):
    gold, target = T.gold_and_target(F.col("truth"), F.col("polarity"))
    return runs6(spark, sf_dir).select("truth", "polarity").distinct().withColumns({"gold_said": gold, "target_said": target})


@query(f"""with {RUNS3}, e as (select model, item_id from runs3 group by all having max(decide) filter (condition = 'record_true') = 'consistent'), d as (select model, count(*) as n, sha256(string_agg(item_id::varchar, chr(10) order by item_id::varchar) || chr(10)) as ids from e group by model)
    select count(*) as models, count(distinct ids) as denominators, min(n) as least_n, max(n) as most_n from d""")
def denominator_audit(spark, sf_dir):
    """Whether every model has the same eligible items, by digest of the sorted ids."""
    w = pairs.pivot_conditions(runs3(spark, sf_dir), ["model", "item_id"], "condition", ["record_true"], ["decide"])
    d = digests.set_digests(w.where(is_value("decide_record_true", "consistent")), "model", "item_id").select("model", F.col("lines").alias("n"), F.col("sha256").alias("ids"))
    return d.agg(F.count("*").alias("models"), F.count_distinct("ids").alias("denominators"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))


@query("""with o as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations) select conv_id, turn, role from o where role = 'assistant' and before is distinct from 'user'""")
def reply_order_audit(spark, sf_dir):
    """Replies that do not directly follow a question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).where((F.col("role") == "assistant") & ~F.col("before").eqNullSafe(F.lit("user"))).select("conv_id", "turn", "role")


@query("""with s as (select l_orderkey, list(l_returnflag order by l_linenumber, l_returnflag) as f, list(l_linestatus order by l_linenumber, l_linestatus) as g from lineitem group by all)
    select l_orderkey, len(f)::bigint as segments, len(list_filter(range(1, len(f) + 1), lambda i: f[i] <> case g[i] when 'F' then 'A' else 'N' end)) = 1 as one_difference from s""")
def twin_segments(spark, sf_dir):
    """Segment lists that differ from their twin in exactly one place."""
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda x: x[c])
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(part("l_returnflag").alias("f"), part("l_linestatus").alias("g"))
    twin = F.transform("g", lambda x: F.when(x == "F", "A").otherwise("N"))
    return s.select("l_orderkey", F.size("f").cast("long").alias("segments"), audits.one_difference(F.col("f"), twin).alias("one_difference"))
