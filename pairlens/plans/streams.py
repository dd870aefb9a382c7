"""Queries on journals that are taken in as streams, and on the live state of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators.durable import scratch
from pairlens.plans.views import table
from pairlens.sources import writers
from pairlens.streaming import calls, journal

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select event_type, count(*) as n, count(*) filter (user_id % 2 = 0) as even from events group by event_type")
def journal_summary(spark, sf_dir):
    """Events in a journal whose second half is the older one and repeats a part of the first, taken in by two runs of several batches, and summed."""
    log, out, state = (scratch(spark, k) for k in ("journal", "taken", "state"))
    schema = "event_id long, event_type string, even boolean, at timestamp"
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long"), "event_type", (F.col("user_id") % 2 == 0).alias("even"), F.col("ts").cast("timestamp").alias("at"))
    middle = e.agg(F.percentile_approx(F.unix_micros("at"), 0.5).alias("m")).first()["m"] or 0
    older = F.coalesce(F.unix_micros("at") < middle, F.lit(True))
    for part in (e.where(~older), e.where(older | (F.col("event_id") % 3 == 0))):
        writers.append(part.repartition(4), log)
        journal.intake(spark, log, schema, ["event_id"], out, state, ["event_type", "even"], files=2)
    return journal.taken(spark, out, schema).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("even").alias("even"))


CALLS = """rows as (select conv_id as item, conv_id * 1000 + turn as call, turn as round, 'call_started' as event, timestamp '2024-01-01 00:00:00' + to_seconds((conv_id * 100 + turn * 40)::bigint) as ts, null::boolean as ok from conversations where role = 'user'
    union all select conv_id, conv_id * 1000 + turn - 1, turn, 'call_finished', timestamp '2024-01-01 00:00:00' + to_seconds((conv_id * 100 + turn * 40 - 40 + length(coalesce(text, '')) % 80)::bigint), length(coalesce(text, '')) % 7 > 0 from conversations where role = 'assistant')"""


@query(f"""with {CALLS}, c as (select item, call, min({{'ts': ts, 'round': round}}) filter (event = 'call_started') as s, min({{'ts': ts, 'ok': ok}}) filter (event = 'call_finished') as f from rows group by all),
        d as (select *, coalesce(f.ts <= s.ts + interval 60 second, false) as done from c),
        e as (select *, min(case when s.round = 0 and not (done and f.ok) then case when done then f.ts else s.ts + interval 60 second end end) over (partition by item) as stop from d),
        g as (select item, call, case when s is null then 'unstarted' when s.ts > stop then 'refused' when done then 'finished' else 'interrupted' end as state from e)
    select item, call, state, (state in ('finished', 'interrupted'))::int as charged from g""")
def live_calls(spark, sf_dir):
    """Turns of conversations as calls, taken in by a stream in time order that stops and goes on twice: what became of each call."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("item"), "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    at = lambda s: F.timestamp_seconds(F.lit(1704067200).cast("long") + s)
    first = F.col("item") * 100 + F.col("turn") * 40
    started = t.where("role = 'user'").select("item", (F.col("item") * 1000 + F.col("turn")).alias("call"), F.col("turn").alias("round"), F.lit("call_started").alias("event"), at(first).alias("at"), F.lit(None).cast("boolean").alias("ok"))
    finished = t.where("role = 'assistant'").select("item", (F.col("item") * 1000 + F.col("turn") - 1).alias("call"), F.col("turn").alias("round"), F.lit("call_finished").alias("event"), at(first - 40 + F.col("size") % 80).alias("at"), (F.col("size") % 7 > 0).alias("ok"))
    rows = started.unionByName(finished)
    log, out, state = (scratch(spark, k) for k in ("calls", "closed", "state"))
    ends = rows.agg(F.min("at").alias("a"), F.max("at").alias("b")).select(F.unix_seconds("a").alias("a"), F.unix_seconds("b").alias("b")).first()
    cuts = [ends["a"] or 0, *[((ends["a"] or 0) * (3 - k) + (ends["b"] or 0) * k) // 3 for k in (1, 2)], (ends["b"] or 0) + 1]
    last = spark.range(1).select(F.lit(-1).cast("long").alias("item"), F.lit(-1).cast("long").alias("call"), F.lit(0).cast("long").alias("round"), F.lit("closed").alias("event"), F.timestamp_seconds(F.lit(cuts[-1] + 86400)).alias("at"), F.lit(None).cast("boolean").alias("ok"))
    schema = "item long, call long, round long, event string, at timestamp, ok boolean"
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = rows.where((F.unix_seconds("at") >= lo) & (F.unix_seconds("at") < hi))
        writers.append(part.unionByName(last) if k == 2 else part, log)
        calls.run_live(spark.readStream.schema(schema).json(log), 60, "1 second", out, state)
    return spark.read.schema(calls.OUT).parquet(out).select("item", "call", "state", "charged")
