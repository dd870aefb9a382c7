"""Queries on selection, ranking, splits and integrity audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.operators import audits, digests, ranking
from pairlens.plans.views import RUNS3, STATES, runs3, sql_bucket, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("family"), "source", H.keyed("seed1", F.col("doc_id"), "rank").alias("h"))


ITEMS = "items as (select doc_id as item_id, lang as family, source, sha256(concat_ws(':', 'seed1', doc_id, 'rank')) as h from documents)"


@query(f"with {ITEMS} select item_id, family, h, row_number() over (order by h, item_id) - 1 as rank from items")
def hash_rank(spark, sf_dir):
    """Every item's place in a seeded hash order, without a single sorted partition."""
    return ranking.ranked(items(spark, sf_dir), ["h", "item_id"]).select("item_id", "family", "h", "rank")


@query(f"with {ITEMS} select item_id, h from items order by h, item_id limit 25")
def hash_top_k(spark, sf_dir):
    return ranking.top_k(items(spark, sf_dir), ["h", "item_id"], 25).select("item_id", "h")


@query(f"with {ITEMS}, r as (select *, row_number() over (partition by family order by h, item_id) - 1 as turn from items) select item_id, family, turn from r")
def interleaved_order(spark, sf_dir):
    return ranking.interleaved(items(spark, sf_dir), "family", ["h", "item_id"]).select("item_id", "family", F.col("turn").cast("long").alias("turn"))


@query(f"""with {ITEMS}, r as (select *, row_number() over (partition by family order by h, item_id) - 1 as rank from items)
    select item_id, family, case when rank < 20 then 'discovery' when rank < 45 then 'validation' when rank < 60 then 'test' else 'unused' end as split from r""")
def stratified_splits(spark, sf_dir):
    r = ranking.ranked(items(spark, sf_dir), ["h", "item_id"], ["family"], wide=True)
    return r.select("item_id", "family", ranking.splits(F.col("rank"), [("discovery", 20), ("validation", 25), ("test", 15)], "unused").alias("split"))


@query(f"""with {ITEMS}, r as (select *, row_number() over (partition by family order by h, item_id) - 1 as rank, dense_rank() over (order by family) - 1 as f from items)
    select item_id, family, rank, case when (rank + f) % 2 = 0 then 'direct' else 'reverse' end as polarity, (rank + 2 * f) % 6 as permutation from r where rank between 5 and 24""")
def family_slices(spark, sf_dir):
    """Ranks 5 to 24 of each family with alternating polarity and a permutation by rank and family."""
    r = ranking.ranked(items(spark, sf_dir), ["h", "item_id"], ["family"], wide=True)
    names = r.select("family").distinct().withColumn("f", F.dense_rank().over(Window.orderBy("family")) - 1)
    r = r.where(F.col("rank").between(5, 24)).join(F.broadcast(names), "family")
    return r.select("item_id", "family", F.col("rank").cast("long").alias("rank"), F.when((F.col("rank") + F.col("f")) % 2 == 0, "direct").otherwise("reverse").alias("polarity"), ((F.col("rank") + 2 * F.col("f")) % 6).cast("long").alias("permutation"))


@query(f"""with {ITEMS}, r as (select *, row_number() over (order by h, item_id) - 1 as rank from items)
    select item_id, rank % 6 as cell, (['abc','acb','bac','bca','cab','cba'])[(rank % 6)::int + 1] as layout, rank % 5 as shard, (['direct','reasoned','read'])[((0 + rank) % 3)::int + 1] as first_arm from r""")
def counterbalance(spark, sf_dir):
    """Cells of six in hash order, their layout, index shards of five and the arm that a rotation puts first."""
    r = ranking.ranked(items(spark, sf_dir), ["h", "item_id"])
    layouts = F.array(*[F.lit(x) for x in ("abc", "acb", "bac", "bca", "cab", "cba")])
    arms = ranking.rotated(F.array(F.lit("direct"), F.lit("reasoned"), F.lit("read")), F.col("rank"))
    return r.select("item_id", (F.col("rank") % 6).cast("long").alias("cell"), F.element_at(layouts, (F.col("rank") % 6 + 1).cast("int")).alias("layout"), (F.col("rank") % 5).cast("long").alias("shard"), F.element_at(arms, 1).alias("first_arm"))


@query(f"""with {RUNS3}, left_over as (select model, item_id, condition from runs3 where {sql_bucket(10, "'done'", "model", "item_id", "condition")} >= 4),
        d as (select *, dense_rank() over (partition by model order by item_id) - 1 as r from left_over)
    select model, r % 4 as shard, count(*) as rows, count(distinct item_id) as items from d group by all""")
def resume_and_shard(spark, sf_dir):
    """Rows not done yet, dealt to four shards with all rows of an item together."""
    r = runs3(spark, sf_dir)
    b = H.bucket(10, "done", F.col("model"), F.col("item_id"), F.col("condition"))
    done = r.where(b < 4).select("model", "item_id", "condition")
    rest = r.join(done, ["model", "item_id", "condition"], "left_anti")
    d = rest.withColumn("r", F.dense_rank().over(Window.partitionBy("model").orderBy("item_id")) - 1)
    return d.groupBy("model", (F.col("r") % 4).cast("long").alias("shard")).agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"))


@query()
def sequential_allocation(spark, sf_dir):
    """Families take compatible items in turn, most restrictive first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", H.keyed("alloc", F.col("doc_id")).alias("h"))
    wants = [("long_german", (F.col("lang") == "de") & (F.col("n_chars") > 2000), 6), ("german", F.col("lang") == "de", 6), ("short", F.col("n_chars") < 600, 8), ("any", F.lit(True), 10)]
    return ranking.allocate(d, wants, "doc_id", ["h", "doc_id"])


@query()
def greedy_policy_cover(spark, sf_dir):
    """Lines numbers as policies that succeed on orders; four steps of greatest additional cover."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ranking.greedy_cover(li.select(F.col("l_linenumber").alias("policy"), F.col("l_orderkey").alias("item")), "policy", "item", 4)


@query("""with s as (select doc_id, text, n_chars, (lang = 'en')::int as k from documents), w as (select *, count(*) over (partition by sha256(text)) as n from s)
    select case when n >= 10 then '10+' when n >= 5 then '5-9' when n >= 2 then '2-4' else '1' end as copies, count(*) as rows from w group by 1""")
def repetition_bins(spark, sf_dir):
    """Rows by how often their text occurs, counted by digest with partial aggregation."""
    n = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    c = F.col("n")
    return n.groupBy(F.when(c >= 10, "10+").when(c >= 5, "5-9").when(c >= 2, "2-4").otherwise("1").alias("copies")).agg(F.sum("n").alias("rows"))


def observed(spark, sf_dir):
    """runs3 with faults: rows dropped, doubled and altered by hash."""
    r = runs3(spark, sf_dir)
    b = H.bucket(1000, "fault", F.col("model"), F.col("item_id"), F.col("condition"))
    r = r.withColumn("b", b).where("b >= 10").withColumn("family", F.when(F.col("b").between(10, 19), "zz").otherwise(F.col("family")))
    return r.withColumn("copy", F.explode(F.when(F.col("b").between(20, 29), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("b")


OBSERVED = f"""{RUNS3}, faulty as (select *, {sql_bucket(1000, "'fault'", "model", "item_id", "condition")} as b from runs3),
    observed as (select model, item_id, case when b between 10 and 19 then 'zz' else family end as family, source, condition, decide from faulty, (select unnest([1, 2]) as copy) c where b >= 10 and (copy = 1 or b between 20 and 29))"""


@query(f"""with {OBSERVED}, e as (select model, item_id, condition, count(*) as e from runs3 group by all), o as (select model, item_id, condition, count(*) as o from observed group by all),
        j as (select model, item_id, condition, coalesce(e, 0) as e, coalesce(o, 0) as o from e full join o using (model, item_id, condition))
    select unnest(list_filter([case when o > 1 then 'duplicate' end, case when o = 0 then 'missing' end, case when e = 0 then 'extra' end], lambda x: x is not null)) as rule, concat_ws('|', model, item_id, condition) as key, o::varchar as detail from j""")
def coverage_audit(spark, sf_dir):
    return audits.coverage(runs3(spark, sf_dir), observed(spark, sf_dir), ["model", "item_id", "condition"])


@query(f"""with {OBSERVED} select 'drift' as rule, concat_ws('|', m.model, m.item_id, m.condition) as key, 'family' as detail from runs3 m join observed o using (model, item_id, condition) where m.family is distinct from o.family""")
def drift_audit(spark, sf_dir):
    return audits.drift(runs3(spark, sf_dir), observed(spark, sf_dir), ["model", "item_id", "condition"], ["family", "source", "decide"])


@query(f"""with {OBSERVED} select 'conditions' as rule, concat_ws('|', model, item_id) as key, string_agg(distinct condition, ',' order by condition) as detail from observed group by model, item_id
        having count(*) <> 3 or count(distinct condition) <> 3
    union all select 'varies', item_id::varchar, 'family' from observed group by item_id having count(distinct family) > 1
    union all select 'balance', 'condition', min(n) || '..' || max(n) from (select condition, count(*) as n from observed group by condition) having max(n) > min(n)
    union all select 'repeated', concat_ws('|', model, item_id, condition), count(*)::varchar from observed group by model, item_id, condition having count(*) > 1""")
def design_audit(spark, sf_dir):
    """Exact condition sets, invariant fields, balanced conditions, unique signatures: violations as rows."""
    o = observed(spark, sf_dir)
    out = audits.factorial(o, ["model", "item_id"], "condition", STATES)
    for part in (audits.invariance(o, ["item_id"], ["family", "source"]), audits.balance(o, ["condition"]), audits.repeated(o, ["model", "item_id", "condition"])):
        out = out.unionByName(part)
    return out


@query("""select a.source as a, b.source as b, count(*) as shared from (select distinct source, sha256(text) as h from documents) a join (select distinct source, sha256(text) as h from documents) b on a.h = b.h and a.source < b.source group by all""")
def dataset_overlap(spark, sf_dir):
    """Texts shared between sources, by digest, for every pair of sources that share any."""
    return audits.overlap(table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)), "source", "h")


@query("""with c as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)),
        s as (select conv_id * 1000 + turn as call_id, next_role = 'assistant' as closed from c where role = 'user')
    select 'finishes' as rule, call_id::varchar as key, '1/0' as detail from s where closed is not true""")
def journal_audit(spark, sf_dir):
    """Every user turn opens a call that the next assistant turn of the conversation closes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).withColumn("open_turn", F.lag("turn").over(w))
    start = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.lit("call_started").alias("event"), F.col("turn").alias("at"), F.col("conv_id").alias("request"))
    end = c.where("role = 'assistant' and before = 'user'").select((F.col("conv_id") * 1000 + F.col("open_turn")).alias("call_id"), F.lit("call_finished").alias("event"), F.col("turn").alias("at"), F.col("conv_id").alias("request"))
    return audits.journal(start.unionByName(end), "call_id", "event", "at", ["request"])


@query("""with l as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'read' else 'decision' end as kind, l_suppkey % 2 as candidate, l_linestatus = 'F' and l_quantity < 3 as success from lineitem),
        c as (select *, row_number() over w as place, lag(kind) over w as kind_before, lag(candidate) over w as candidate_before, count(*) over (partition by l_orderkey, l_linenumber) as copies, max(l_linenumber) over (partition by l_orderkey) as last
            from l window w as (partition by l_orderkey order by l_linenumber, kind, candidate))
    select unnest(list_filter([case when place <> l_linenumber then 'index' end, case when copies > 1 then 'duplicate' end, case when kind = 'read' and (kind_before is distinct from 'decision' or candidate_before is distinct from candidate) then 'read_order' end,
        case when success and l_linenumber <> last then 'after_success' end, case when place > 5 then 'budget' end], lambda x: x is not null)) as rule, l_orderkey || '|' || l_linenumber as key, kind as detail from c""")
def adjacency_audit(spark, sf_dir):
    """All order lines as calls: indices 1..n, each once, reads behind the decision on their candidate, success last, a budget of five."""
    c = table(spark, sf_dir, "lineitem").withColumns({
        "kind": F.when(F.col("l_returnflag") == "R", "read").otherwise("decision"), "candidate": F.col("l_suppkey") % 2, "success": (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 3),
    })
    return audits.adjacency(c, ["l_orderkey"], "l_linenumber", "kind", "candidate", "success", 5)


@query("""select 'domain' as rule, l_orderkey || '|' || l_linenumber as key, case when not (l_quantity between 1 and 45) then 'quantity' when l_discount > 0.08 then 'discount' when l_returnflag not in ('A', 'N') then 'flag' end as detail
    from lineitem where not (l_quantity between 1 and 45) or l_discount > 0.08 or l_returnflag not in ('A', 'N')""")
def domain_audit(spark, sf_dir):
    checks = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") <= 0.08, "flag": F.col("l_returnflag").isin("A", "N")}
    return audits.domains(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], checks)


@query("""with n as (select source, lang, count(*) as n from documents group by all), g as (select a.source, b.lang, coalesce(n, 0) as n from (select distinct source from documents) a cross join (select distinct lang from documents) b left join n using (source, lang))
    select 'cell' as rule, source || '|' || lang as key, n::varchar as detail from g where n <> (select max(n) from g)""")
def product_balance_audit(spark, sf_dir):
    return audits.product_balance(table(spark, sf_dir, "documents"), "source", "lang")


@query("""with a as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as k from documents) select lang, sha256(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar) || chr(10)) as id_digest,
        sha256(string_agg(sha256(lang || k), chr(10) order by doc_id)) as sequence_digest from a group by lang""")
def set_digests(spark, sf_dir):
    """Digest of a sorted id set, and of a sequence of hashes in order of position."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a = ranking.ranked(ranking.with_digits(d, "doc_id", "place"), ["place"], ["lang"], wide=True)
    ids = digests.set_digests(d, "lang", "doc_id").select("lang", F.col("sha256").alias("id_digest"))
    lines = F.sha2(F.concat(F.col("lang"), (F.col("rank") + 1).cast("string")), 256)
    return ids.join(digests.sequence_digests(a, "lang", ["doc_id"], lines).select("lang", F.col("sha256").alias("sequence_digest")), "lang")


@query("""with h as (select doc_id, sha256(concat_ws(':', 'pick', doc_id)) as x from documents) select doc_id, upper(substr(x, 1, 8)) as record_id, substr(x, 1, 12) as opaque_id, (('0x' || substr(x, 1, 16))::ubigint % 7)::bigint as choice,
        ('0x' || substr(x, 1, 2))::int % 2 as parity, list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: ('0x' || substr(x, i::int, 1))::int)), lambda a, d: (a * 16 + d) % 97)::bigint as whole,
        (list_sum(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1)))) + 5)::bigint % 11 as char_index from h""")
def hash_choices(spark, sf_dir):
    """Ids, choices and parities that come from digests."""
    h = table(spark, sf_dir, "documents").select("doc_id", H.keyed("pick", F.col("doc_id")).alias("x"))
    x = F.col("x")
    return h.select("doc_id", H.record_id(x).alias("record_id"), H.opaque_id(x).alias("opaque_id"), H.leading(x, 16, 7).alias("choice"), H.first_bit(x).alias("parity"), H.whole_mod(x, 97).cast("long").alias("whole"), H.character_index(F.col("doc_id").cast("string"), 5, 11).cast("long").alias("char_index"))
