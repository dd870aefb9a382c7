"""Score cards of strategies, rates of source priors, severities, missing keys dealt to shards, greedy cover by bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.functions.nulls import is_value, rate
from pairlens.operators import audits, pairs, ranking
from pairlens.plans.paired import WIDE3, wilson_sql
from pairlens.plans.views import RUNS3, RUNS6, runs3, runs6, sql_bucket, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {WIDE3}, w as (select model, item_id, max(decide) filter (condition = 'source_absent') as a, max(decide) filter (condition = 'record_true') as t, max(decide) filter (condition = 'record_false') as f, count(*) filter (decide is null) as unparsed from runs3 group by all),
        s as (select w.model, count(*) as items, count(*) filter (a = 'absent') as absent_k, count(*) filter (t = 'consistent') as true_k, count(*) filter (f = 'inconsistent') as false_k, count(*) filter (t = 'consistent' and f = 'inconsistent') as pair_k,
            count(*) filter (eligible) as dc_n, count(*) filter (eligible and hit) as dc_k, count(*) filter (eligible and aware) as eor_n, count(*) filter (eligible and aware and hit) as eor_k, sum(unparsed)::bigint as unparsed from w join wide3 x on x.model = w.model and x.item_id = w.item_id group by w.model)
    select model, items, absent_k, true_k, false_k, pair_k, dc_n, dc_k, eor_n, eor_k, unparsed, round((true_k + false_k)::double / (2 * items), 9) as balanced, round(pair_k::double / items, 9) as pair_accuracy, round(dc_n::double / items, 9) as control_coverage,
        round(dc_k::double / nullif(dc_n, 0), 9) as dc_asr, {wilson_sql("dc_k", "dc_n")[0]} as dc_low, {wilson_sql("dc_k", "dc_n")[1]} as dc_high, round(eor_k::double / nullif(eor_n, 0), 9) as eor, {wilson_sql("eor_k", "eor_n")[0]} as eor_low, {wilson_sql("eor_k", "eor_n")[1]} as eor_high from s""")
def double_control_card(spark, sf_dir):
    """A card a model: accuracy by condition, balanced and pair accuracy, control coverage, and what an attack gains among controlled and aware items."""
    r = runs3(spark, sf_dir)
    w = pairs.pivot_conditions(r, ["model", "item_id"], "condition", ["source_absent", "record_true", "record_false"], ["decide"])
    a, t, f = is_value("decide_source_absent", "absent"), is_value("decide_record_true", "consistent"), is_value("decide_record_false", "inconsistent")
    missing = sum((F.col(f"decide_{c}").isNull().cast("int") for c in ("source_absent", "record_true", "record_false")), F.lit(0))
    s = w.groupBy("model").agg(F.count("*").alias("items"), F.count_if(a).alias("absent_k"), F.count_if(t).alias("true_k"), F.count_if(f).alias("false_k"), F.count_if(t & f).alias("pair_k"), F.sum(missing).alias("unparsed"))
    d = pairs.double_control(r, ["model"])
    c = s.join(d, "model").withColumns({"balanced": rate(F.col("true_k") + F.col("false_k"), 2 * F.col("items")), "pair_accuracy": rate(F.col("pair_k"), F.col("items")), "control_coverage": rate(F.col("dc_n"), F.col("items"))})
    return pairs.rounded(c.withColumnsRenamed({"dc_rate": "dc_asr", "eor_rate": "eor"}).select(
        "model", "items", "absent_k", "true_k", "false_k", "pair_k", "dc_n", "dc_k", "eor_n", "eor_k", "unparsed", "balanced", "pair_accuracy", "control_coverage", "dc_asr", "dc_low", "dc_high", "eor", "eor_low", "eor_high",
    ))


@query(f"""with {RUNS6}, p as (select model, polarity, case when decide = 'consistent' then 'yes' when decide = 'inconsistent' then 'no' end as said, case when (truth = 'true') = (polarity = 'direct') then 'no' else 'yes' end as target from runs6)
    select model, polarity, count(*) as items, count(said) as n, round(count(said)::double / count(*), 9) as parse_rate, round(count(*) filter (said = target)::double / nullif(count(said), 0), 9) as target_prior_rate, round(count(*) filter (said = 'yes')::double / nullif(count(said), 0), 9) as yes_rate
    from p group by grouping sets ((model, polarity), (model))""")
def source_prior_rates(spark, sf_dir):
    """What a question alone makes a model say, by polarity and over all: parsed answers, target answers, yes."""
    said = F.when(is_value("decide", "consistent"), "yes").when(is_value("decide", "inconsistent"), "no")
    target = F.when((F.col("truth") == "true") == (F.col("polarity") == "direct"), "no").otherwise("yes")
    p = runs6(spark, sf_dir).select("model", "polarity", said.alias("said"), target.alias("target"))
    g = p.groupingSets([[F.col("model"), F.col("polarity")], [F.col("model")]], F.col("model"), F.col("polarity")).agg(F.count("*").alias("items"), F.count("said").alias("n"), F.count_if(F.col("said") == F.col("target")).alias("k"), F.count_if(F.col("said") == "yes").alias("y"))
    return pairs.rounded(g.select("model", "polarity", "items", "n", rate(F.col("n"), F.col("items")).alias("parse_rate"), rate(F.col("k"), F.col("n")).alias("target_prior_rate"), rate(F.col("y"), F.col("n")).alias("yes_rate")))


@query("""with s as (select p_partkey, p_size::double as t, p_size + p_partkey % 4 as subtle, p_size + 2.0 + p_partkey % 3 as moderate, p_size - (p_partkey % 7) as extreme from part),
        d as (select p_partkey, abs(subtle - t) as a, abs(moderate - t) as b, abs(extreme - t) as c from s)
    select case when least(a, b, c) <= 0.05 then 'equal' else 'order' end as rule, p_partkey::varchar as key, concat_ws('|', case when a <= 0.05 then 'subtle' end, case when b <= 0.05 then 'moderate' end, case when c <= 0.05 then 'extreme' end) as detail
    from d where least(a, b, c) <= 0.05 or not (a < b and b < c)""")
def severity_audit(spark, sf_dir):
    """Counterfactual values that equal the truth, or whose distances do not grow with severity."""
    k, t = F.col("p_partkey"), F.col("p_size").cast("double")
    s = table(spark, sf_dir, "part").select("p_partkey", t.alias("truth"), (t + k % 4).alias("subtle"), (t + 2.0 + k % 3).alias("moderate"), (t - k % 7).alias("extreme"))
    return audits.severity(s, ["p_partkey"], "truth", ["subtle", "moderate", "extreme"])


@query(f"""with {RUNS3}, missing as (select model, item_id, condition from runs3 where {sql_bucket(7, "'kept'", "model", "item_id", "condition")} > 1), r as (select *, row_number() over (order by item_id, model, condition) - 1 as n from missing)
    select model, item_id, condition, n % 5 as shard from r""")
def missing_shards(spark, sf_dir):
    """Keys that a prefix lacks, in order of the keys, dealt to five shards one by one."""
    r = runs3(spark, sf_dir).select("model", "item_id", "condition")
    done = r.where(H.bucket(7, "kept", F.col("model"), F.col("item_id"), F.col("condition")) <= 1)
    missing = r.join(done, ["model", "item_id", "condition"], "left_anti")
    n = ranking.ranked(ranking.with_digits(missing, "item_id", "place"), ["place", "model", "condition"], wide=True)
    return n.select("model", "item_id", "condition", (F.col("rank") % 5).cast("long").alias("shard"))


COVER = "cover as (select distinct l_suppkey % 24 as policy, l_orderkey as item from lineitem where l_returnflag = 'R')"
STEP = """c{0} as (select policy, count(*) as gain, {0} as place from cover where item not in (select item from cover where policy in (select policy from (values (null::bigint)) n(policy) where false {1})) group by policy order by gain desc, policy desc limit 1)"""


@query(f"with {COVER}, " + ", ".join(STEP.format(k, "".join(f" union all select policy from c{j}" for j in range(k))) for k in range(4)) + " select place, policy, gain from c0 union all select * from (select place, policy, gain from c1) union all select place, policy, gain from c2 union all select place, policy, gain from c3")
def greedy_cover_sequence(spark, sf_dir):
    """Four of 24 policies, each the one that covers most orders not covered yet, by bitmaps; ties go to the largest policy."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ranking.bitmap_cover(li.select((F.col("l_suppkey") % 24).alias("policy"), F.col("l_orderkey").alias("item")), "policy", "item", 4)
