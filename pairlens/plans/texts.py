"""Queries on answer text: parsers, normalisers, transcriptions, the record checker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.functions import record as R
from pairlens.functions import text as T
from pairlens.functions import text_exact as X
from pairlens.operators.pairs import rounded
from pairlens.operators.patterns import AUTOMATON, token_hits
from pairlens.plans.views import dealt, sql_bucket, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RAW = ["(A).", "b", "The answer is C.", "inconsistent with the record", "Consistent!", "Yes, it is", "no", "```json\n{\"claim\": \"TRUE\"}\n```", "I say {\"claim\": \"false\"} here", "none of it", "Thinking\nFINAL: B", "FINAL: A\nFINAL: B", "LEFT", "", "the 2,000 Dogs", "An apple a day, two", "-3.5 degrees", "1 or 2"]


def answers(spark, sf_dir):
    raw = F.array(*[F.lit(x) for x in RAW])
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", F.element_at(raw, (H.bucket(len(RAW), "raw", F.col("doc_id")) + 1).cast("int")).alias("raw"))


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ANSWERS = f"answers as (select doc_id, ([{', '.join(map(q, RAW))}])[{sql_bucket(len(RAW), q('raw'), 'doc_id')} + 1] as raw from documents)"


@query(f"""with {ANSWERS}, a as (select doc_id, raw, trim(raw, e' \\n\\t') as t, regexp_replace(regexp_replace(raw, '^```[A-Za-z]*\\s*', ''), '\\s*```$', '') as body from answers)
    select doc_id, raw, nullif(upper(regexp_extract(t, '(?i)^\\(?([ABC])\\)?\\.?$', 1)), '') as bare, nullif(regexp_extract(upper(raw), '\\b([ABC])\\b', 1), '') as stray,
        case when regexp_matches(upper(raw), '\\b[ABC]\\b') then map {{'A': 'consistent', 'B': 'inconsistent', 'C': 'absent'}}[regexp_extract(upper(raw), '\\b([ABC])\\b', 1)]
             when contains(lower(raw), 'internally inconsistent') or trim(regexp_replace(lower(raw), '[^a-z]+', ' ', 'g')) = 'inconsistent' then 'inconsistent'
             when contains(lower(raw), 'internally consistent') or trim(regexp_replace(lower(raw), '[^a-z]+', ' ', 'g')) = 'consistent' then 'consistent' end as choice,
        case when regexp_matches(lower(t), '^\\(?a\\)?(\\s|$|[.,:;])') then 'a' when regexp_matches(lower(t), '^\\(?b\\)?(\\s|$|[.,:;])') then 'b' when regexp_matches(lower(t), '\\bno\\b') then 'a' when regexp_matches(lower(t), '\\byes\\b') then 'b' else 'invalid' end as binary_said,
        case when len(regexp_extract_all(raw, 'FINAL:')) = 1 then nullif(regexp_extract(t, '(?:^|\\n)FINAL:\\s*\\(?([A-C])\\)?\\.?$', 1), '') end as reasoned,
        coalesce(case when upper(regexp_extract(body, '\\{{.*?\\}}')) <> '' then upper(json_extract_string(regexp_extract(body, '\\{{.*?\\}}'), '$.claim'))
             when contains(upper(raw), 'FALSE') then 'FALSE' when contains(upper(raw), 'TRUE') then 'TRUE' when contains(upper(raw), 'NONE') then 'NONE' end, 'PARSE_ERROR') as verdict,
        nullif(substr(regexp_extract(upper(t), '^\\(?(LEFT|RIGHT|L|R)\\)?\\b', 1), 1, 1), '') as side from a""")
def answer_parsers(spark, sf_dir):
    """Every parser over the same raw answers; levels of strictness stay apart."""
    raw = F.col("raw")
    options = F.create_map(F.lit("A"), F.lit("consistent"), F.lit("B"), F.lit("inconsistent"), F.lit("C"), F.lit("absent"))
    return answers(spark, sf_dir).select("doc_id", "raw", T.bare_option(raw).alias("bare"), T.stray_choice(raw).alias("stray"), T.choice(raw, options).alias("choice"), T.binary_answer(raw).alias("binary_said"), T.reasoned(raw).alias("reasoned"), T.task_verdict(raw).alias("verdict"), T.side(raw).alias("side"))


@query(f"""with {ANSWERS} select doc_id, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) as claim, regexp_replace(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), 's+$', '') as label,
        trim(split_part(trim(raw, e' \\n\\t'), chr(10), 1)) as first_line, upper(trim(raw, '().! ')) as letter,
        case when len(regexp_extract_all(raw, '[-+]?\\d+(?:\\.\\d+)?')) = 1 then regexp_extract(raw, '[-+]?\\d+(?:\\.\\d+)?')::double end as number from answers""")
def answer_normalizers(spark, sf_dir):
    raw = F.col("raw")
    return answers(spark, sf_dir).select("doc_id", T.normalize_claim(raw).alias("claim"), F.regexp_replace(T.normalize_claim(raw), "s+$", "").alias("label"), T.first_line(raw).alias("first_line"), T.trimmed_letter(raw).alias("letter"), T.one_number(raw).alias("number"))


#: What RAW and ten reference answers are when normalised, written down from the rule.
NORMAL = ["a", "b", "answer is c", "inconsistent with record", "consistent", "yes it is", "no", "json claim true", "i say claim false here", "none of it", "thinking final b", "final final b", "left", "", "2000 dogs", "apple day 2", "3 5 degrees", "1 or 2"]
TEN = ["no", "No.", "no", "yes", "yes", "b", "2000 dogs", "two", "apple day 2", "left"]
TEN_NORMAL = ["no", "no", "no", "yes", "yes", "b", "2000 dogs", "2", "apple day 2", "left"]


@query(f"""with a as (select doc_id, ([{', '.join(map(q, NORMAL))}])[{sql_bucket(len(RAW), q('raw'), 'doc_id')} + 1] as normal from documents),
        h as (select *, len(list_filter([{', '.join(map(q, TEN_NORMAL))}], lambda x: x = normal)) as hits from a)
    select doc_id, normal, round((hits * least(1.0, (hits - 1) / 3.0) + (10 - hits) * least(1.0, hits / 3.0)) / 10, 9) as consensus, (normal = 'no')::int::double as exact from h""")
def answer_scores(spark, sf_dir):
    """Normalised answers, consensus scores over ten answers, and exact scores over two."""
    # each literal is normalised once, each answer once a row
    normal = answers(spark, sf_dir).select("doc_id", T.normalize_answer(F.col("raw")).alias("normal"))
    ten = spark.range(1).select(F.array(*[T.normalize_answer(F.lit(x)) for x in TEN]).alias("ten"))
    d = normal.crossJoin(F.broadcast(ten))
    return rounded(d.select("doc_id", "normal", T.consensus_of(F.col("normal"), F.col("ten")).alias("consensus"), T.consensus_of(F.col("normal"), F.slice("ten", 1, 2)).alias("exact")))


@query("""with t as (select doc_id, lower(coalesce(text, 'None')) as t from documents),
        c as (select doc_id, t, trim(regexp_replace(regexp_replace(regexp_replace(t, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g'), '[^a-z0-9'']+', ' ', 'g')) as n from t),
        w as (select doc_id, t, string_split(n, ' ') as w from c)
    select doc_id, case when regexp_matches(t, '^[\\s\\x0B\\x{85}\\p{Z}]*\\(?a\\)?([\\s\\x0B\\x{85}\\p{Z}.,:;]|$)') then 'a' when regexp_matches(t, '^[\\s\\x0B\\x{85}\\p{Z}]*\\(?b\\)?([\\s\\x0B\\x{85}\\p{Z}.,:;]|$)') then 'b'
            when regexp_matches(t, '(^|[^\\p{L}\\p{N}_])no([^\\p{L}\\p{N}_]|$)') then 'a' when regexp_matches(t, '(^|[^\\p{L}\\p{N}_])yes([^\\p{L}\\p{N}_]|$)') then 'b' else 'invalid' end as binary_said,
        md5(case when len(w) = 1 and w[1] in ('a', 'an', 'the') then w[1] else array_to_string(list_transform(list_filter(w, lambda x: x not in ('a', 'an', 'the')),
            lambda x: coalesce(map {'zero': '0', 'one': '1', 'two': '2', 'three': '3', 'four': '4', 'five': '5', 'six': '6', 'seven': '7', 'eight': '8', 'nine': '9', 'ten': '10'}[x], x)), ' ') end) as normal from w""")
def document_answers(spark, sf_dir):
    """Binary answers and normal forms of all whole document texts; a text may open with its letter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("None")).alias("t"))
    return d.select("doc_id", T.binary_answer(F.col("t")).alias("binary_said"), F.md5(T.normalize_answer(F.col("t"))).alias("normal"))


def whole_hits(documents, benchmark, most=AUTOMATON):
    """How many benchmark texts stand whole in each document (doc_id, text), token by token; documents without any are left out."""
    b = benchmark.select(T.normalize_claim(F.col("text")).alias("x"))
    return token_hits(documents.select("doc_id", T.normalize_claim(F.col("text")).alias("t")), b, "doc_id", "t", "x", most)


@query("""with d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from documents),
        b as (select trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as x from benchmark)
    select doc_id, count(*) as found from d join b on contains(t, ' ' || x || ' ') where x <> '' group by doc_id""")
def transcription_hits(spark, sf_dir):
    """Benchmark texts that stand whole and in a row in a document."""
    return whole_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("""with w as (select doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)) as have,
        list_distinct(list_filter(string_split(trim(regexp_replace(lower(source || ' the of and ' || lang), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)) as want from documents)
    select doc_id, round(len(list_intersect(want, have))::double / len(want), 9) as recall from w""")
def token_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", T.token_recall(F.col("text"), F.concat_ws(" ", "source", F.lit("the of and"), "lang"), 2).alias("recall")))


@query()
def page_text(spark, sf_dir):
    """Plain text of pages; SQL has no table of all entities, so tests hold it against the standard library."""
    return table(spark, sf_dir, "pages").select("page_id", X.plain_text("html").alias("plain"))


NO_ASSUMPTION = "no assumption"


def records(spark, sf_dir):
    """Records of all eight families, printed from order lines, with their assumptions; the seventh lines state a wrong one."""
    li = dealt(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b"), F.round(F.col("l_tax") * 100).cast("int").alias("s"))
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    clock = lambda x: F.lpad(x.cast("string"), 2, "0")
    parts = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    tenth = lambda x: (x / F.lit(10)).cast("decimal(10,1)")
    hundredth = lambda x: (x / F.lit(100)).cast("decimal(10,2)")
    texts = {
        "range_threshold": parts("Temp ", a, " C | safe range 5 to 40 C | uncertainty ± 0.5 C"),
        "unit_conversion": parts("SOURCE ", a, " C | CONVERTED ", tenth(a * 18 + 320 + (b % 2) * 10), " F | ROUNDING TOLERANCE +/- 0.5 F"),
        "temporal_ledger": parts("START 10:", clock(a), " | FINISH 11:", clock(b), " | ELAPSED ", 60 + b - a + s % 3, " MIN | CLOCK RESOLUTION +/- 1 MIN"),
        "capacity_conservation": parts("CAPACITY ", a + b - s, " L | ADDED ", a, "+", b, " L | SPILL ", F.when(a % 3 == 0, s + 2).otherwise(s), " L | UNCERTAINTY +/- 1 L"),
        "causal_order": parts("STOPPED 10:", clock(a), " | BRAKE APPLIED 10:", clock(a + b), " | CLOCK RESOLUTION +/- 1 MIN"),
        "geometry_feasibility": F.concat(parts("RIGID WIDTH ", tenth(a), " M | OPENING ", tenth(20 + b), " M | UNCERTAINTY +/- 0.1 M"), F.when(F.col("l_linenumber") == 6, " | OPENING 1 M").otherwise("")),
        "probability_ledger": parts("P(PASS) ", hundredth(a), " | P(FAIL) ", hundredth(100 - a - b % 3), " | TOTAL 1.00 | ROUNDING +/- 0.01"),
        "phase_state": parts("TEMP ", 4 * a - 60, " C | PRESSURE 1.00 ATM | STATE LIQUID WATER | UNCERTAINTY +/- 0.5 C / +/- 0.01 ATM"),
    }
    said = {**R.ASSUMPTIONS, "unit_conversion": R.CONVERSION_ASSUMPTION.format(R.CONVERSIONS["C", "F"][0])}
    which = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    text = reduce(lambda x, kv: F.when(which == kv[0], texts[kv[1]]).otherwise(x), enumerate(R.MARKERS), F.lit(None).cast("string"))
    stated = reduce(lambda x, kv: F.when(which == kv[0], said[kv[1]]).otherwise(x), enumerate(R.MARKERS), F.lit(None).cast("string"))
    return li.select("l_orderkey", "l_linenumber", "a", "b", "s", text.alias("text"), F.when(F.col("l_linenumber") == 7, NO_ASSUMPTION).otherwise(stated).alias("said"))


@query(f"""with r as (select l_orderkey, l_linenumber, ([{', '.join(map(q, ['range_threshold', 'unit_conversion', 'temporal_ledger', 'capacity_conservation', 'causal_order', 'geometry_feasibility', 'probability_ledger', 'phase_state']))}])[(l_orderkey + l_linenumber) % 8 + 1] as family,
        l_quantity::int as a, round(l_discount * 100)::int as b, round(l_tax * 100)::int as s from lineitem),
    w as (select *, case when l_linenumber = 7 then 'unsupported_assumptions' when family = 'causal_order' and a + b > 59 then 'invalid_clock' when family = 'geometry_feasibility' and l_linenumber = 6 then 'missing_or_duplicate_opening'
            when family = 'phase_state' and a in (15, 40) then 'unsupported_phase_boundary_or_pressure' end as reason,
        case family when 'range_threshold' then a >= 6 and a <= 39 when 'unit_conversion' then b % 2 = 0 when 'temporal_ledger' then s % 3 <= 1 when 'capacity_conservation' then a % 3 <> 0 and a + b >= s when 'causal_order' then b <= 1
            when 'geometry_feasibility' then a - 20 - b <= 1 when 'probability_ledger' then b % 3 <= 1 else a between 16 and 39 end as ok from r)
    select l_orderkey, l_linenumber, family, case when reason is null then case when ok then 'consistent' else 'inconsistent' end end as prediction, reason from w""")
def record_checker(spark, sf_dir):
    """What the checker says about every printed record."""
    r = R.checked(records(spark, sf_dir), "text", "said", "c")
    return r.select("l_orderkey", "l_linenumber", "c.family", "c.prediction", "c.reason")


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k from events""")
def nested_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_fields(F.col("props"), ["k"])["k"].cast("long").alias("k"))


SCENARIOS = [
    "temperature-safe-range-v2", "celsius-fahrenheit-conversion-v2", "start-finish-elapsed-time-v2", "capacity-addition-spill-balance-v2", "cause-precedes-effect-v2", "rigid-width-opening-clearance-v2",
    "exclusive-exhaustive-probability-sum-v2", "water-phase-at-temperature-pressure-v2",
]


@query("""with r as (select l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 as which, l_quantity::int as a, round(l_discount * 100)::int as b, round(l_tax * 100)::int as s from lineitem),
        x as (select *, case which when 0 then greatest(0.0, a + 0.5 - 40, 5 - (a - 0.5)) when 1 then (b % 2)::double when 2 then -(s % 3)::double when 3 then case when a % 3 = 0 then -2.0 else 0.0 end when 4 then b::double when 5 then greatest(0, a - 20 - b) / 10.0
            when 6 then -(b % 3) / 100.0 else case when 4 * a - 60 > 0 and 4 * a - 60 < 100 then 0.0 else 1.0 end end as residual from r)
    select l_orderkey, l_linenumber, round(residual, 6) + 0.0 as residual, case when abs(residual) <= 0.001 then 'false_within_tolerance' when which = 5 and l_linenumber = 6 then 'leaks_answer' end as reason,
        case which when 0 then printf('%.1f C', greatest(0.0, 5.5 - a, a - 39.5)) when 1 then printf('%.2f F', a * 1.8 + 32) when 2 then (60 + b - a) || ' MIN' when 3 then case when a + b >= s then printf('%.1f L', s::double) end when 4 then case when a + b > 59 then null when b = 0 then 'AT THE SAME TIME' else 'AFTER THE STOP' end
            when 5 then printf('%.2f M', greatest(0, a - 20 - b) / 10.0) when 6 then printf('%.2f', (a + b) / 100.0) else case when 4 * a - 60 in (0, 100) then null when 4 * a - 60 < 0 then 'SOLID ICE' when 4 * a - 60 < 100 then 'LIQUID WATER' else 'WATER VAPOR' end end as derived,
        round(s * 0.5, 6) as mass from x""")
def record_residuals(spark, sf_dir):
    """Printed records by the rule of their scenario: residual, why a false one would not stand apart, the value that its input lines imply, and a mass ledger over panels."""
    r = records(spark, sf_dir).withColumn("which", F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8)).cast("int"))
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    p = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tenth = lambda x: (x / F.lit(10)).cast("decimal(10,1)")
    hundredth = lambda x: (x / F.lit(100)).cast("decimal(10,2)")
    lines = {
        "range_threshold": F.array(p("TEMP ", a, " C"), F.lit("UNCERTAINTY +/- 0.5 C"), F.lit("SAFE LOWER 5 C"), F.lit("SAFE UPPER 40 C")), "unit_conversion": F.array(p("SOURCE ", a, " C"), F.lit("DESTINATION UNIT F")),
        "temporal_ledger": F.array(p("START 10:", two(a)), p("FINISH 11:", two(b))), "capacity_conservation": F.array(p("CAPACITY ", a + b - s, " L"), p("ADDED FIRST ", a, " L"), p("ADDED SECOND ", b, " L")),
        "causal_order": F.array(p("STOPPED 10:", two(a)), p("BRAKE APPLIED 10:", two(a + b))), "geometry_feasibility": F.array(p("RIGID WIDTH ", tenth(a), " M"), p("OPENING ", tenth(20 + b), " M")),
        "probability_ledger": F.array(p("P(PASS) ", hundredth(a)), p("P(FAIL) ", hundredth(b))), "phase_state": F.array(p("TEMP ", 4 * a - 60, " C"), F.lit("PRESSURE 1.00 ATM")),
    }
    of = lambda values: F.element_at(F.array(*values), F.col("which") + 1)
    residual = R.residual(F.col("text"), of([F.lit(x) for x in SCENARIOS]), F.lit("uncertainty 0.5 C"))
    panels = F.array(p("START MASS ", 100 + a, " G | REMOVED ", a, " G"), p("ADDED ", b, " G"), p("FINAL MASS ", 100 + b, ".0 G | FINAL MASS ", (100 + b + s / F.lit(2)).cast("decimal(10,1)"), " G"))
    out = r.withColumns({"residual": residual, "lines": F.array_join(of([lines[x] for x in R.MARKERS]), " | ")})
    return out.select("l_orderkey", "l_linenumber", (F.round("residual", 6) + 0.0).alias("residual"), R.separation(F.col("residual"), F.lit(0.0), F.lit(0.001), [F.col("text")], "OPENING 1 M").alias("reason"), R.derived_value(of([F.lit(x) for x in R.MARKERS]), F.array("lines")).alias("derived"), F.round(R.mass_residual(panels), 6).alias("mass"))
