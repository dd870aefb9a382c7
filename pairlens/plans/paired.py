"""Queries on paired and factorial logs: controls, twins, shared populations, exact tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions.hashing import bucket
from pairlens.functions.nulls import is_value, rate, truthy
from pairlens.functions.stats import cluster_error, discordant, holm, interval_alpha, mcnemar, wilson
from pairlens.operators import fixed_bootstrap, pairs, resample
from pairlens.operators.fixed_bootstrap import means_sql as fixed_sql
from pairlens.operators.resample import DRAWS, means_sql
from pairlens.plans.views import CUES, MODELS, RUNS3, RUNS5, RUNS6, literals, runs3, runs5, runs6, sql_bucket, sql_list, table

QUERIES, ORACLE_SQL = {}, {}
Z = "1.959963984540054"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """round(low, 9) and round(high, 9) of the interval, null for n = 0."""
    p, nn = f"({k}::double / nullif({n}, 0))", f"nullif({n}, 0)::double"
    mid = f"(({p} + {Z}*{Z} / (2 * {nn})) / (1 + {Z}*{Z} / {nn}))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {nn} + {Z}*{Z} / (4 * {nn} * {nn})) / (1 + {Z}*{Z} / {nn}))"
    return f"case when {n} > 0 then round(greatest(0.0, {mid} - {half}), 9) end", f"case when {n} > 0 then round(least(1.0, {mid} + {half}), 9) end"


def rate_sql(name: str) -> str:
    low, high = wilson_sql(f"{name}_k", f"{name}_n")
    return f"{name}_n, {name}_k, round({name}_k::double / nullif({name}_n, 0), 9) as {name}_rate, {low} as {name}_low, {high} as {name}_high"


WIDE3 = f"""{RUNS3}, wide3 as (
        select model, item_id, family, source,
               coalesce(max(case when condition = 'source_absent' then decide end) = 'absent', false) and coalesce(max(case when condition = 'record_true' then decide end) = 'consistent', false) as eligible,
               coalesce(bool_or(case when condition = 'record_false' then read_match end), false) and coalesce(max(case when condition = 'record_false' then knowledge end) = 'inconsistent', false) as aware,
               coalesce(max(case when condition = 'record_false' then decide end) = 'consistent', false) as hit
        from runs3 group by all
    )"""


@query(f"""with {WIDE3}, s as (
        select model, family, count(*) filter (eligible) as dc_n, count(*) filter (eligible and hit) as dc_k,
               count(*) filter (eligible and aware) as eor_n, count(*) filter (eligible and aware and hit) as eor_k from wide3 group by model, family)
    select model, family, {rate_sql("dc")}, {rate_sql("eor")} from s""")
def three_state_rates(spark, sf_dir):
    return pairs.rounded(pairs.double_control(runs3(spark, sf_dir), ["model", "family"]))


def twins(spark, sf_dir):
    return pairs.pivot_conditions(runs6(spark, sf_dir), ["model", "item_id", "family", "polarity", "cue"], "truth", ["true", "false"], ["decide", "read_match", "knows"])


TWINS = f"""{RUNS6}, twins as (
        select model, item_id, family, polarity, cue, max(case when truth = 'true' then decide end) as dt, max(case when truth = 'false' then decide end) as df,
               coalesce(bool_or(case when truth = 'false' then read_match end), false) as read_f, coalesce(bool_or(case when truth = 'false' then knows end), false) as knows_f
        from runs6 group by all)"""


@query(f"""with {TWINS}, s as (select model, cue, count(*) as items, count(*) filter (dt = 'consistent') as true_ok, count(*) filter (df = 'inconsistent') as false_ok,
        count(*) filter (dt = 'consistent' and df = 'inconsistent') as both_ok, count(*) filter (dt is distinct from df) as flips, count(*) filter (dt is not distinct from df) as invariant,
        count(*) filter (dt = 'consistent') as ind_n, count(*) filter (dt = 'consistent' and df = 'consistent') as ind_k,
        count(*) filter (dt = 'consistent' and read_f and knows_f) as eor_n, count(*) filter (dt = 'consistent' and read_f and knows_f and df = 'consistent') as eor_k from twins group by model, cue)
    select model, cue, items, true_ok, false_ok, both_ok, round(both_ok::double / items, 9) as both_rate, flips, invariant, {rate_sql("ind")}, {rate_sql("eor")} from s""")
def twin_metrics(spark, sf_dir):
    t = twins(spark, sf_dir)
    true_ok, false_ok = is_value("decide_true", "consistent"), is_value("decide_false", "inconsistent")
    same = F.col("decide_true").eqNullSafe(F.col("decide_false"))
    counts = t.groupBy("model", "cue").agg(
        F.count("*").alias("items"), F.count_if(true_ok).alias("true_ok"), F.count_if(false_ok).alias("false_ok"), F.count_if(true_ok & false_ok).alias("both_ok"),
        F.count_if(~same).alias("flips"), F.count_if(same).alias("invariant"),
    ).withColumn("both_rate", rate(F.col("both_ok"), F.col("items")))
    hit = is_value("decide_false", "consistent")
    aware = true_ok & truthy("read_match_false") & truthy("knows_false")
    return pairs.rounded(counts.join(pairs.rates(t, ["model", "cue"], ind=(true_ok, hit), eor=(aware, hit)), ["model", "cue"]))


@query(f"""with {TWINS}, shared as (select model, item_id from twins group by all having bool_and(coalesce(dt = 'consistent', false))),
        s as (select model, cue, coalesce(polarity, 'all') as polarity, count(*) as ind_n, count(*) filter (df = 'consistent') as ind_k
              from twins semi join shared using (model, item_id) group by grouping sets ((model, cue), (model, cue, polarity)))
    select model, cue, polarity, {rate_sql("ind")} from s""")
def common_population_rates(spark, sf_dir):
    """Items eligible under every cue, pooled and by polarity, in one pass over grouping sets."""
    t = twins(spark, sf_dir)
    ok = pairs.common_to_all(t, ["model", "item_id"], is_value("decide_true", "consistent"))
    kept = t.join(ok, ["model", "item_id"], "left_semi").withColumn("hit", is_value("decide_false", "consistent"))
    two = kept.select("model", "cue", "polarity", "hit").unionByName(kept.select("model", "cue", F.lit("all").alias("polarity"), "hit"))
    return pairs.rounded(pairs.rates(two, ["model", "cue", "polarity"], ind=(F.lit(True), F.col("hit"))))


MCNEMAR_SQL = """case when b + c = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
    lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) end"""


@query(f"""with {WIDE3}, paired as (
        select r.family, r.model, l.hit as base_hit, r.hit from wide3 l join wide3 r on l.item_id = r.item_id where l.model = 'm0' and r.model <> 'm0' and l.eligible and r.eligible),
        s as (select model, family, count(*) as n, count(*) filter (base_hit) as base_k, count(*) filter (hit) as k, count(*) filter (base_hit and not hit) as b, count(*) filter (hit and not base_hit) as c from paired group by model, family),
        p as (select *, {MCNEMAR_SQL} as p from s), w as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by round(p, 9), model) as r from p)
    select model, family, n, base_k, k, b as base_only, c as other_only, round(p, 6) as p,
           round(max(least(1.0, (m - r + 1) * round(p, 9))) over (partition by family order by r rows unbounded preceding), 6) as holm_p from w""")
def shared_control_tests(spark, sf_dir):
    """Each model against the first on items whose controls are right under both; exact McNemar, Holm by family."""
    wide = pairs.pivot_conditions(runs3(spark, sf_dir), ["model", "item_id", "family"], "condition", ["source_absent", "record_true", "record_false"], ["decide"])
    ok = wide.where(is_value("decide_source_absent", "absent") & is_value("decide_record_true", "consistent")).select("model", "item_id", "family", is_value("decide_record_false", "consistent").alias("hit"))
    base = ok.where("model = 'm0'").select("item_id", F.col("hit").alias("base_hit"))
    both = ok.where("model <> 'm0'").join(base, "item_id")
    s = both.groupBy("model", "family").agg(F.count("*").alias("n"), F.count_if("base_hit").alias("base_k"), F.count_if("hit").alias("k"), *discordant(F.col("base_hit"), F.col("hit")))
    s = s.withColumn("p", F.round(mcnemar(F.col("a_only"), F.col("b_only")), 9))
    out = holm(s, "p", ["family"], ["model"])
    return pairs.rounded(out.select("model", "family", "n", "base_k", "k", F.col("a_only").alias("base_only"), F.col("b_only").alias("other_only"), F.round("p", 6).alias("p"), F.round("holm_p", 6).alias("holm_p")))


@query(f"""with {RUNS5}, ok as (select model, item_id from runs5 where condition like 'clean%' group by all having bool_and(coalesce(parsed = gold, false))),
        e as (select * from runs5 semi join ok using (model, item_id) where condition not like 'clean%'),
        s as (select model, condition, coalesce(cell::varchar, 'pooled') as stratum, count(*) as ok_n, count(*) filter (parsed = gold) as ok_k from e group by grouping sets ((model, condition), (model, condition, cell)))
    select model, condition, stratum, {rate_sql("ok")} from s""")
def clean_conditioned_rates(spark, sf_dir):
    """Rates by condition among items whose clean controls are right, pooled and by stratum."""
    r = runs5(spark, sf_dir)
    right = F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False))
    clean = F.col("condition").startswith("clean")
    ok = pairs.common_to_all(r.where(clean), ["model", "item_id"], right)
    e = r.where(~clean).join(ok, ["model", "item_id"], "left_semi").withColumn("right", right)
    s = e.withColumn("stratum", F.explode(F.array(F.lit("pooled"), F.col("cell").cast("string"))))
    return pairs.rounded(pairs.rates(s, ["model", "condition", "stratum"], ok=(F.lit(True), F.col("right"))))


@query(f"""with {RUNS5}, ok as (select model, item_id from runs5 where condition like 'clean%' group by all having bool_and(coalesce(parsed = gold, false))),
        c as (select model, condition, cell, count(*) as n, avg((coalesce(parsed = gold, false))::int) as rate from runs5 semi join ok using (model, item_id) where condition not like 'clean%' group by all)
    select model, condition, count(*) as strata, min(n) as least_n, max(n) as most_n, round(avg(rate), 9) as macro_rate from c group by model, condition""")
def macro_rates(spark, sf_dir):
    """Mean over strata of the stratum rates, with the number of strata and their sizes."""
    r = runs5(spark, sf_dir)
    right = F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False))
    clean = F.col("condition").startswith("clean")
    ok = pairs.common_to_all(r.where(clean), ["model", "item_id"], right)
    cells = r.where(~clean).join(ok, ["model", "item_id"], "left_semi").groupBy("model", "condition", "cell").agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("rate"))
    return pairs.rounded(cells.groupBy("model", "condition").agg(F.count("*").alias("strata"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.avg("rate").alias("macro_rate")))


@query(f"""with {RUNS5}, c as (select condition, model, avg((coalesce(parsed = gold, false))::int) as rate from runs5 group by all)
    select condition, count(*) as models, round(avg(rate), 9) as macro_rate from c group by condition""")
def cross_model_macro(spark, sf_dir):
    right = F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False))
    per = runs5(spark, sf_dir).groupBy("condition", "model").agg(F.avg(right.cast("int")).alias("rate"))
    return pairs.rounded(per.groupBy("condition").agg(F.count("*").alias("models"), F.avg("rate").alias("macro_rate")))


@query(f"""with {RUNS5}, ok as (select model, item_id from runs5 where condition like 'clean%' group by all having bool_and(coalesce(parsed = gold, false))),
        w as (select model, item_id, bool_or(condition = 'flat_false' and coalesce(parsed = 'consistent', false)) as flat, bool_or(condition = 'scene_false' and coalesce(parsed = 'consistent', false)) as scene,
              bool_or(condition = 'scene_false' and exact_read) as scene_read, bool_or(condition = 'flat_false' and exact_read) as flat_read from runs5 semi join ok using (model, item_id) group by all),
        s as (select model, count(*) as n, count(*) filter (flat and flat_read) as flat_k, count(*) filter (scene and scene_read) as scene_k, count(*) filter (flat and flat_read and not (scene and scene_read)) as b, count(*) filter (scene and scene_read and not (flat and flat_read)) as c from w group by model)
    select model, n, flat_k, scene_k, round((scene_k - flat_k)::double / n, 9) as difference, b as flat_only, c as scene_only, round({MCNEMAR_SQL}, 6) as p from s""")
def strict_success_pairs(spark, sf_dir):
    """Strict success (target answered and exactly read) of two renderings on the same clean-eligible items."""
    r = runs5(spark, sf_dir)
    ok = pairs.common_to_all(r.where(F.col("condition").startswith("clean")), ["model", "item_id"], F.col("parsed") == F.col("gold"))
    w = pairs.pivot_conditions(r.join(ok, ["model", "item_id"], "left_semi"), ["model", "item_id"], "condition", ["flat_false", "scene_false"], ["parsed", "exact_read"])
    flat = is_value("parsed_flat_false", "consistent") & truthy("exact_read_flat_false")
    scene = is_value("parsed_scene_false", "consistent") & truthy("exact_read_scene_false")
    s = w.groupBy("model").agg(F.count("*").alias("n"), F.count_if(flat).alias("flat_k"), F.count_if(scene).alias("scene_k"), *discordant(flat, scene))
    return pairs.rounded(s.select("model", "n", "flat_k", "scene_k", rate(F.col("scene_k") - F.col("flat_k"), F.col("n")).alias("difference"), F.col("a_only").alias("flat_only"), F.col("b_only").alias("scene_only"), F.round(mcnemar(F.col("a_only"), F.col("b_only")), 6).alias("p")))


@query(f"""with {RUNS6}, r as (select model, cue, truth, avg((coalesce(decide = 'consistent', false))::int) as rate from runs6 where cue <> 'authority' group by all),
        w as (select model, max(rate) filter (cue = 'values_only' and truth = 'true') as v_true, max(rate) filter (cue = 'values_only' and truth = 'false') as v_false,
              max(rate) filter (cue = 'explicit_conclusion' and truth = 'true') as e_true, max(rate) filter (cue = 'explicit_conclusion' and truth = 'false') as e_false from r group by model)
    select model, round(((e_true + e_false) - (v_true + v_false)) / 2, 9) as cue_effect, round(((v_true + e_true) - (v_false + e_false)) / 2, 9) as truth_effect,
           round((e_true - e_false) - (v_true - v_false), 9) as interaction from w""")
def factorial_effects(spark, sf_dir):
    """Main effects and interaction of a two by two design of rates."""
    r = runs6(spark, sf_dir).where("cue <> 'authority'").groupBy("model").pivot("condition", ["values_only_true", "values_only_false", "explicit_conclusion_true", "explicit_conclusion_false"]).agg(F.avg(is_value("decide", "consistent").cast("int")))
    vt, vf, et, ef = (F.col(c) for c in ("values_only_true", "values_only_false", "explicit_conclusion_true", "explicit_conclusion_false"))
    return pairs.rounded(r.select("model", ((et + ef - vt - vf) / 2).alias("cue_effect"), ((vt + et - vf - ef) / 2).alias("truth_effect"), ((et - ef) - (vt - vf)).alias("interaction")))


DID = f"""{RUNS6}, did as (select model, item_id, family, sum(case when cue = 'explicit_conclusion' then 1 when cue = 'values_only' then -1 else 0 end * case truth when 'false' then 1 else -1 end * (coalesce(decide = 'consistent', false))::int)::bigint as d
        from runs6 group by all)"""


def did(spark, sf_dir):
    """Item-level difference in differences: an integer from -2 to 2."""
    cue = F.when(F.col("cue") == "explicit_conclusion", 1).when(F.col("cue") == "values_only", -1).otherwise(0)
    sign = F.when(F.col("truth") == "false", 1).otherwise(-1)
    return runs6(spark, sf_dir).groupBy("model", "item_id", "family").agg(F.sum(cue * sign * is_value("decide", "consistent").cast("int")).alias("d"))


@query(f"""with {DID}, per as (select model, family, sum(d) as s, count(*) as m from did group by all),
        t as (select model, sum(s)::double / sum(m) as mean, sum(m)::bigint as n, count(*) as g from per group by model),
        e as (select t.model, t.mean, t.n, t.g, sqrt(sum((s - m * mean) * (s - m * mean)) * g / (g - 1)) / n as error from per join t using (model) group by t.model, t.mean, t.n, t.g)
    select model, g as clusters, n, round(mean, 9) as mean, round(error, 9) as error, round(mean / error, 6) as z, round(mean - {Z} * error, 9) as low, round(mean + {Z} * error, 9) as high,
           mean - {Z} * error > 0 as positive from e""")
def difference_in_differences(spark, sf_dir):
    """Mean contribution with the cluster-robust interval over families, and whether it is above zero."""
    out = cluster_error(did(spark, sf_dir), "family", "d", ["model"])
    return pairs.rounded(out.withColumn("z", F.round("z", 6)).withColumn("positive", F.col("low") > 0))


@query(f"""with {RUNS6}, per as (select model, item_id, polarity, count(*) filter (coalesce(decide = gold, false)) as right_n, count(*) filter (coalesce(decide = 'consistent', false) and gold <> 'consistent') as target_n, count(*) as n from runs6 group by all),
        prior as (select item_id, polarity, bool_and(right_n >= 4) as prior_ok from per where model = 'm0' group by all),
        j as (select p.model, p.polarity, prior_ok, target_n > 0 as attacked from per p join prior using (item_id, polarity) where p.model <> 'm0')
    select model, polarity, count(*) as items, count(*) filter (prior_ok) as prior_n, count(*) filter (prior_ok and attacked) as attacked_only,
           round((count(*) filter (prior_ok and attacked))::double / nullif(count(*) filter (prior_ok), 0), 9) as induced_rate from j group by model, polarity""")
def prior_adjusted_induction(spark, sf_dir):
    """Six rows an item collapse to one, the first model's serves as prior, and induction counts items it had right."""
    right = F.coalesce(F.col("decide") == F.col("gold"), F.lit(False))
    target = is_value("decide", "consistent") & (F.col("gold") != "consistent")
    per = runs6(spark, sf_dir).groupBy("model", "item_id", "polarity").agg(F.count_if(right).alias("right_n"), F.count_if(target).alias("target_n"))
    prior = per.where("model = 'm0'").select("item_id", (F.col("right_n") >= 4).alias("prior_ok"))
    j = per.where("model <> 'm0'").join(prior, "item_id")
    out = j.groupBy("model", "polarity").agg(F.count("*").alias("items"), F.count_if("prior_ok").alias("prior_n"), F.count_if(F.col("prior_ok") & (F.col("target_n") > 0)).alias("attacked_only"))
    return pairs.rounded(out.withColumn("induced_rate", rate(F.col("attacked_only"), F.col("prior_n"))))


@query(f"""with {RUNS5}, b as (select model, item_id, bool_and(coalesce(parsed = gold, false)) as all_ok, bool_and(coalesce(parsed = gold, true)) as optimistic_ok,
              bool_and(coalesce(parsed = gold, false)) filter (condition like 'clean%') as controls_ok, bool_and(coalesce(parsed = gold, false)) filter (condition = 'scene_false') as scene_ok from runs5 group by all)
    select model, count(*) as items, count(*) filter (all_ok) as pairs_ok, count(*) filter (optimistic_ok) as optimistic, count(*) filter (controls_ok and not scene_ok) as control_failures from b group by model""")
def pair_vectors(spark, sf_dir):
    """Items right in all conditions, with unparsed answers counted wrong and right, and failures behind right controls."""
    ok, maybe = F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False)), F.coalesce(F.col("parsed") == F.col("gold"), F.lit(True))
    b = runs5(spark, sf_dir).groupBy("model", "item_id").agg(F.bool_and(ok).alias("all_ok"), F.bool_and(maybe).alias("optimistic_ok"), F.bool_and(F.when(F.col("condition").startswith("clean"), ok)).alias("controls_ok"), F.bool_and(F.when(F.col("condition") == "scene_false", ok)).alias("scene_ok"))
    return b.groupBy("model").agg(F.count("*").alias("items"), F.count_if("all_ok").alias("pairs_ok"), F.count_if("optimistic_ok").alias("optimistic"), F.count_if(F.col("controls_ok") & ~F.col("scene_ok")).alias("control_failures"))


@query(f"""with {RUNS3}, w as (select model, item_id, max(decide) filter (condition = 'source_absent') as a, max(decide) filter (condition = 'record_true') as t, max(decide) filter (condition = 'record_false') as f, count(*) filter (decide is null) as unparsed, count(decide) as parsed from runs3 group by all),
        s as (select model, count(*) as items, count(*) filter (a = 'absent') as absent_ok, count(*) filter (t = 'consistent') as true_ok, count(*) filter (f = 'inconsistent') as false_ok, count(*) filter (a = 'absent' and t = 'consistent' and f = 'inconsistent') as triples_ok, sum(unparsed)::bigint as unparsed, sum(parsed)::bigint as parsed from w group by model)
    select model, items, absent_ok, true_ok, false_ok, triples_ok, round((absent_ok + true_ok + false_ok)::double / (3 * items), 9) as balanced_accuracy, round(parsed::double / (3 * items), 9) as coverage, unparsed from s""")
def strategy_score_card(spark, sf_dir):
    w = pairs.pivot_conditions(runs3(spark, sf_dir), ["model", "item_id"], "condition", ["source_absent", "record_true", "record_false"], ["decide"])
    a, t, f = is_value("decide_source_absent", "absent"), is_value("decide_record_true", "consistent"), is_value("decide_record_false", "inconsistent")
    missing = sum((F.col(f"decide_{c}").isNull().cast("int") for c in ("source_absent", "record_true", "record_false")), F.lit(0))
    s = w.groupBy("model").agg(F.count("*").alias("items"), F.count_if(a).alias("absent_ok"), F.count_if(t).alias("true_ok"), F.count_if(f).alias("false_ok"), F.count_if(a & t & f).alias("triples_ok"), F.sum(missing).alias("unparsed"))
    return pairs.rounded(s.withColumns({"balanced_accuracy": rate(F.col("absent_ok") + F.col("true_ok") + F.col("false_ok"), 3 * F.col("items")), "coverage": rate(3 * F.col("items") - F.col("unparsed"), 3 * F.col("items"))}))


RATINGS = f"""ratings as (select doc_id as item_id, lang as method, annotator, 1 + {sql_bucket(5, "'rate'", "doc_id", "annotator")} as legibility, 1 + ({sql_bucket(3, "'base'", "doc_id")} + {sql_bucket(3, "'rate2'", "doc_id", "annotator")}) as scene_fit
        from documents, {sql_list("annotator", ["a1", "a2", "a3"])} a)"""


def ratings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("method"))
    r = d.crossJoin(literals(spark, "annotator", ["a1", "a2", "a3"]))
    i, a = F.col("item_id"), F.col("annotator")
    return r.select("item_id", "method", "annotator", (1 + bucket(5, "rate", i, a)).alias("legibility"), (1 + bucket(3, "base", i) + bucket(3, "rate2", i, a)).alias("scene_fit"))


@query(f"""with {RATINGS}, seen as (select * from ratings where {sql_bucket(4, "'seen'", "item_id", "annotator")} > 0),
        pairs as (select a.method, (a.scene_fit - b.scene_fit) ** 2 as x from seen a join seen b on a.item_id = b.item_id and a.annotator < b.annotator),
        o as (select method, avg(x) as observed from pairs group by method),
        e as (select method, count(*) as n, (count(*) * sum(scene_fit * scene_fit) - sum(scene_fit) * sum(scene_fit))::double / (count(*) * (count(*) - 1) / 2) as expected from seen group by method)
    select e.method, n as ratings, round(1 - observed / expected, 9) as alpha from e left join o on o.method = e.method""")
def rating_agreement(spark, sf_dir):
    """Agreement by method; a quarter of the ratings is missing, so some items are rated once."""
    r = ratings(spark, sf_dir).where(bucket(4, "seen", F.col("item_id"), F.col("annotator")) > 0)
    return pairs.rounded(interval_alpha(r, "item_id", "scene_fit", ["method"]))


@query(f"""with {RATINGS}, d as (select item_id, avg(legibility) filter (annotator = 'a2') - avg(legibility) filter (annotator = 'a1') as d from ratings group by item_id),
        m as ({means_sql("(select * from d where d is not null)", "1 as one", "item_id", "d", 5)})
    select 'a1' as left_method, 'a2' as right_method, (select count(*) from d where d is not null) as items, (select round(avg(d), 6) from d) as difference, count(*) as draws,
        round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def matched_difference(spark, sf_dir):
    """Difference of two raters' item means over the items that both rated, with its interval."""
    return resample.matched_difference(ratings(spark, sf_dir), "item_id", "annotator", "legibility", "a1", "a2", DRAWS, 5)


@query(f"""with {RATINGS} select method, count(*) as n, count(distinct item_id) as items, count(distinct annotator) as annotators, min(legibility) as least, max(legibility) as most, round(avg(legibility), 9) as mean, round(median(legibility), 9) as median, round(avg(scene_fit), 9) as fit_mean from ratings group by method""")
def rating_distribution(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return pairs.rounded(r.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.count_distinct("annotator").alias("annotators"), F.min("legibility").alias("least"), F.max("legibility").alias("most"), F.avg("legibility").alias("mean"), F.median("legibility").alias("median"), F.avg("scene_fit").alias("fit_mean")))


@query(f"""with {RATINGS}, v as (select item_id, count(*) as votes, count(*) filter (legibility >= 3) as legible, count(*) filter (scene_fit >= 3) as fits from ratings group by all)
    select item_id, votes, legible, fits, legible >= votes // 2 + 1 and fits >= votes // 2 + 1 as accepted from v""")
def majority_gate(spark, sf_dir):
    """Accepted where more than half of the votes agree on every field."""
    v = ratings(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("votes"), F.count_if(F.col("legibility") >= 3).alias("legible"), F.count_if(F.col("scene_fit") >= 3).alias("fits"))
    need = F.floor(F.col("votes") / 2) + 1
    return v.withColumn("accepted", (F.col("legible") >= need) & (F.col("fits") >= need))


@query(f"""with {RATINGS}, again as (select *, (legibility + {sql_bucket(2, "'again'", "item_id", "annotator")}) % 6 as second from ratings where {sql_bucket(10, "'dup'", "item_id", "annotator")} = 0)
    select annotator, count(*) as pairs, round(avg(abs(legibility - second)), 9) as mean_error from again group by annotator""")
def repeated_rating_error(spark, sf_dir):
    """Mean absolute difference of the two copies of items that an annotator saw twice."""
    i, a = F.col("item_id"), F.col("annotator")
    r = ratings(spark, sf_dir).where(bucket(10, "dup", i, a) == 0)
    r = r.withColumn("second", (F.col("legibility") + bucket(2, "again", i, a)) % 6)
    return pairs.rounded(r.groupBy("annotator").agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("legibility") - F.col("second"))).alias("mean_error")))


@query(f"""with {WIDE3}, s as (select model, source, count(*) filter (eligible) as n, count(*) filter (eligible and hit) as k from wide3 group by all),
        t as (select model, count(*) as cells, sum(n)::bigint as pooled_n, sum(k)::bigint as pooled_k, count(*) filter (n > 0 and k * 2 > n) as positive_cells from s group by model),
        m as ({fixed_sql("(select model, 'all' as one, case when hit then 1 else -1 end as effect from wide3 where eligible)", "model", "one", "effect", 9001)}),
        i as (select model, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by model)
    select model, cells, pooled_n, pooled_k, round(pooled_k::double / nullif(pooled_n, 0), 9) as pooled_rate, positive_cells, low, high,
           case when cells <> (select count(distinct source) from documents) then 'incomplete' when coalesce(low > 0, false) and positive_cells >= 6 then 'supported' else 'not supported' end as claim from t left join i using (model)""")
def pooled_claim_gate(spark, sf_dir):
    """Cell-local eligibility pooled over cells, and the claim that the pooled bootstrap lies above zero and six cells or more are positive; another number of cells than planned is incomplete."""
    r = runs3(spark, sf_dir)
    cells = pairs.double_control(r, ["model", "source"])
    positive = (F.col("dc_n") > 0) & (F.col("dc_k") * 2 > F.col("dc_n"))
    out = cells.groupBy("model").agg(F.count("*").alias("cells"), F.sum("dc_n").alias("pooled_n"), F.sum("dc_k").alias("pooled_k"), F.count_if(positive).alias("positive_cells"))
    # an item counts one for a hit and minus one for none, so the mean is the effect
    values = cells.select("model", F.explode(F.array(F.struct(F.lit(1.0).alias("effect"), F.col("dc_k").alias("rows")), F.struct(F.lit(-1.0).alias("effect"), (F.col("dc_n") - F.col("dc_k")).alias("rows")))).alias("x")).select("model", F.lit("all").alias("one"), "x.effect", "x.rows")
    ends = resample.intervals(fixed_bootstrap.bootstrap_means(values, ["model"], "one", "effect", DRAWS, 9001, rows="rows"), ["model"]).select("model", "low", "high")
    planned = table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("planned"))
    out = out.join(ends, "model", "left").join(F.broadcast(planned), F.lit(True))
    above = F.coalesce(F.col("low") > 0, F.lit(False)) & (F.col("positive_cells") >= 6)
    claim = F.when(F.col("cells") != F.col("planned"), "incomplete").when(above, "supported").otherwise("not supported")
    return pairs.rounded(out.select("model", "cells", "pooled_n", "pooled_k", rate(F.col("pooled_k"), F.col("pooled_n")).alias("pooled_rate"), "positive_cells", "low", "high", claim.alias("claim")))


TRUE_RIGHT = f"""{RUNS3}, right3 as (select model, item_id, source, coalesce(max(decide) filter (condition = 'record_true') = 'consistent', false)::int as ok from runs3 group by all),
    versus as (select b.model, a.item_id, a.source, a.ok as a, b.ok as b, b.ok - a.ok as d from right3 a join right3 b using (item_id) where a.model = 'm0' and b.model in ('m1', 'm2'))"""


@query(f"""with {TRUE_RIGHT}, m as ({fixed_sql("versus", "model", "source", "d", 20260914)}),
        i as (select model, count(*) as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by model)
    select model, count(*) as n, sum(a)::bigint as a_count, sum(b)::bigint as b_count, count(*) filter (d > 0) as plus, count(*) filter (d < 0) as minus, round(avg(d), 9) as delta, any_value(draws) as draws, any_value(low) as low, any_value(high) as high
    from versus join i using (model) group by model""")
def stratified_paired_bootstrap(spark, sf_dir):
    """Two models against the first on the same items: paired counts, difference, and its interval by 10,000 resamples of fixed size within sources, pooled."""
    right = runs3(spark, sf_dir).where("condition = 'record_true'").groupBy("item_id", "source").pivot("model", ["m0", "m1", "m2"]).agg(F.max(is_value("decide", "consistent").cast("int")))
    versus = right.select("item_id", "source", F.col("m0").alias("a"), F.explode(F.create_map(F.lit("m1"), F.col("m1"), F.lit("m2"), F.col("m2"))).alias("model", "b")).withColumn("d", F.col("b") - F.col("a"))
    whole = versus.groupBy("model").agg(F.count("*").alias("n"), F.sum("a").alias("a_count"), F.sum("b").alias("b_count"), F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"), F.round(F.avg("d"), 9).alias("delta"))
    return whole.join(resample.intervals(fixed_bootstrap.bootstrap_means(versus, ["model"], "source", "d", DRAWS, 20260914), ["model"]).drop("mean"), "model")


@query(f"""with {RUNS5}, p as (select model, item_id, max((coalesce(parsed = gold, false))::int) filter (condition = 'clean_true') as a, max((coalesce(parsed = gold, false))::int) filter (condition = 'scene_true') as b from runs5 group by all),
        d as (select model, 'all' as one, b - a as d from p), m as ({fixed_sql("d", "model", "one", "d", 31)}), i as (select model, count(*) as draws, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by model)
    select model, any_value(draws) as draws, round(avg(d), 9) as gain, any_value(low) as low, any_value(high) as high from d join i using (model) group by model""")
def paired_gain(spark, sf_dir):
    """Paired bootstrap of a difference: right answers on scene records less those on clean ones, item by item, for each model."""
    ok = F.coalesce(F.col("parsed") == F.col("gold"), F.lit(False)).cast("int")
    p = runs5(spark, sf_dir).groupBy("model", "item_id").agg(*[F.max(F.when(F.col("condition") == c, ok)).alias(k) for k, c in (("a", "clean_true"), ("b", "scene_true"))])
    d = p.select("model", F.lit("all").alias("one"), (F.col("b") - F.col("a")).alias("d"))
    ends = resample.intervals(fixed_bootstrap.bootstrap_means(d, ["model"], "one", "d", DRAWS, 31), ["model"]).drop("mean")
    return ends.join(d.groupBy("model").agg(F.round(F.avg("d"), 9).alias("gain")), "model")
