"""Queries on lookups, slices, expected calls, splits, and on files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions.hashing import bucket
from pairlens.operators import checks
from pairlens.operators.durable import scratch
from pairlens.operators.quantiles import quantiles
from pairlens.plans.views import sql_bucket, table
from pairlens.sources import readers, writers

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def customer_lookup(spark, sf_dir):
    """Orders with their customer's segment; an unknown customer would fail the query."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return checks.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem where l_returnflag in ('A', 'R')")
def wildcard_filter(spark, sf_dir):
    """Lines of listed flags and any status; the filter on flags reaches the scan."""
    li = table(spark, sf_dir, "lineitem").where(checks.wanted(l_returnflag=["A", "R"], l_linestatus=["O", "*"]))
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("select item_id, 'true' as truth, 'direct' as polarity from benchmark union all select item_id, 'false', 'direct' from benchmark")
def truth_twins(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return checks.with_truth(b, ["item_id"], truth="true", polarity="direct").unionByName(checks.with_truth(b, ["item_id"], truth="false", polarity="direct"))


@query("select l_returnflag, count(*) as n, nullif(list_position(['R', 'A'], l_returnflag), 0)::bigint - 1 as place from lineitem group by l_returnflag")
def enum_places(spark, sf_dir):
    """Groups in the order of a list of names; others come without a place."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return g.withColumn("place", checks.place_in(["R", "A"], "l_returnflag"))


@query("select n_nationkey, n_name from nation order by n_nationkey limit 7 offset 5")
def exact_slice(spark, sf_dir):
    """Seven nations from the sixth on; fewer would fail."""
    return checks.exact_slice(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 5, 7)


CALLS = f"""e as (select item_id, c.condition, s.strategy from benchmark, (values ('absent'), ('true'), ('false')) c(condition), (values ('plain'), ('verify')) s(strategy) union all select item_id, 'read', '' from benchmark),
    o as (select * from e where {sql_bucket(9, "'lost'", "item_id", "condition", "strategy")} > 0 union all select * from e where {sql_bucket(9, "'twice'", "item_id", "condition", "strategy")} = 1
        union all select item_id, 'extra', 'plain' from benchmark where {sql_bucket(9, "'extra'", "item_id")} = 0)"""


@query(f"""with {CALLS}, n as (select item_id, condition, strategy, count(*) as n from o group by all)
    select coalesce(e.item_id, n.item_id) as item_id, coalesce(e.condition, n.condition) as condition, coalesce(e.strategy, n.strategy) as strategy,
        case when n.n is null then 'missing' when e.item_id is null then 'unexpected' else 'repeated' end as wrong
    from e full join n on e.item_id = n.item_id and e.condition = n.condition and e.strategy = n.strategy where n.n is null or e.item_id is null or n.n > 1""")
def expected_call_audit(spark, sf_dir):
    """Calls that are missing, unexpected or repeated against items x conditions x strategies and the probes."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    e = checks.expected_calls(items, "item_id", ["absent", "true", "false"], ["plain", "verify"], ["read"])
    key = [F.col("item_id"), F.col("condition"), F.col("strategy")]
    o = e.where(bucket(9, "lost", *key) > 0).unionByName(e.where(bucket(9, "twice", *key) == 1))
    o = o.unionByName(items.where(bucket(9, "extra", F.col("item_id")) == 0).select("item_id", F.lit("extra").alias("condition"), F.lit("plain").alias("strategy")))
    return checks.call_differences(e, o, ["item_id", "condition", "strategy"])


@query(f"""with s as (select doc_id, {sql_bucket(10, "'split'", "doc_id")} as b from documents)
    select doc_id from documents where doc_id not in (select doc_id from s where b in (0, 1))""")
def unused_items(spark, sf_dir):
    """Documents that a prior split did not use for discovery or test; those it called eligible are free."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    b = bucket(10, "split", F.col("doc_id"))
    prior = d.select(*[F.when(b == k, F.col("doc_id")).alias(name) for k, name in enumerate(["discovery", "test", "eligible"])])
    return checks.unused(d, "doc_id", prior, ["discovery", "test"])


@query("select source, min(n_chars) as low, max(n_chars) as high from documents group by source having max(n_chars) - min(n_chars) > 400")
def length_spread(spark, sf_dir):
    """Sources whose documents differ by more than 400 characters."""
    return checks.spread(table(spark, sf_dir, "documents"), ["source"], "n_chars", 400)


@query()
def unique_signatures(spark, sf_dir):
    """Benchmark items with the first signature of theirs that no item before has, out of twice as many as there are items."""
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return checks.unique_signatures(b, "item_id", lambda k: bucket(1_000_003, "signature", F.col("item_id"), k) % (2 * b.count()))


@query("""select distinct case doc_id % 3 when 0 then source when 1 then lang || '@' || source else source || '/' || lang || '/m' end as label, case doc_id % 3 when 1 then lang when 2 then 'm' end as model,
        case doc_id % 3 when 0 then null else source end as dataset, case doc_id % 3 when 2 then lang end as method, case doc_id % 3 when 2 then 2 else 1 end as files from documents""")
def run_registry(spark, sf_dir):
    """Runs by the specs that the sources and languages of documents make."""
    d, s, g = table(spark, sf_dir, "documents"), F.col("source"), F.col("lang")
    spec = F.element_at(F.array(F.concat(s, F.lit("=/a/b.jsonl")), F.concat(g, F.lit("@"), s, F.lit("=/c")), F.concat_ws("/", s, g, F.lit("m=/manifest,/log"))), (F.col("doc_id") % 3 + 1).cast("int"))
    r = d.select(spec.alias("spec")).distinct().select(checks.run_spec(F.col("spec")).alias("r"))
    return r.select("r.label", "r.model", "r.dataset", "r.method", F.size("r.paths").alias("files"))


@query("""with d as (select lang, list_sort(list(n_chars::double)) as v, count(*) as n from documents group by lang)
    select lang, round(list_aggregate(v, 'quantile_cont', 0.9), 6) as linear, v[(round_even(0.9 * (n - 1), 0) + 1)::int] as nearest, v[4] as fourth from d""")
def quantile_rules(spark, sf_dir):
    """The same quantile by its three rules, without gathering a group."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    q = quantiles(d, ["lang"], "v", {"linear": (0.9, "linear"), "nearest": (0.9, "nearest"), "fourth": "index:3"})
    return q.select("lang", F.round("linear", 6).alias("linear"), "nearest", "fourth")


NATION = "n_nationkey, n_name, n_regionkey"


@query(" union all ".join(f"select '{kind}' as kind, n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation" for kind in ("jsonl", "json", "csv", "parquet", "appended", "lines")))
def source_round_trips(spark, sf_dir):
    """Nations written by each writer to the shared folder and read by the reader of the kind."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    schema = "n_nationkey long, n_name string, n_regionkey long"
    paths = {k: scratch(spark, k) for k in ("jsonl", "json", "csv", "parquet", "appended", "lines")}
    writers.once(n, paths["jsonl"], "json")
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(paths["json"])
    writers.csv_summary(n, paths["csv"])
    writers.once(n, paths["parquet"])
    for part in (n.where("n_nationkey < 9"), n.where("n_nationkey >= 9")):
        writers.append(part, paths["appended"])
    writers.ordered_lines(n, paths["lines"], ["n_nationkey"])
    read = {
        "jsonl": readers.jsonl(spark, paths["jsonl"], schema), "json": readers.json_or_jsonl(spark, paths["json"], schema), "csv": readers.csv(spark, paths["csv"], schema),
        "parquet": readers.parquet(spark, paths["parquet"], {"n_nationkey": ["key", "n_nationkey"], "n_name": ["n_name"], "n_regionkey": ["n_regionkey"]}),
        "appended": readers.jsonl(spark, paths["appended"], schema), "lines": readers.shards(spark, paths["lines"], schema).select("n_nationkey", "n_name", "n_regionkey"),
    }
    out = None
    for kind, df in read.items():
        df = df.select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey")
        out = df if out is None else out.unionByName(df)
    return out


@query("select n_regionkey::varchar as region, n_regionkey <> 3 as matches from nation group by n_regionkey")
def rehashed_files(spark, sf_dir):
    """Files hashed again against a manifest that states a wrong hash for the third region."""
    path = scratch(spark, "hashed")
    table(spark, sf_dir, "nation").select(F.to_json(F.struct("*")).alias("value"), F.col("n_regionkey").cast("string").alias("region")).repartition("region").write.partitionBy("region").text(path)
    files = readers.checksums(spark, f"{path}/*/*.txt")
    stated = files.withColumn("sha256", F.when(F.col("path").contains("region=3"), F.lit("0")).otherwise(F.col("sha256")))
    return checks.rehashed(stated, files).groupBy(F.regexp_extract("path", "region=([^/]*)", 1).alias("region")).agg(F.bool_and("matches").alias("matches"))
