"""Literal tables for the native expressions and operators, with nulls, ties and rows in any order."""

import hashlib
import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairlens.functions import hashing as H
from pairlens.functions import record as R
from pairlens.functions import stats as S
from pairlens.functions import text as T
from pairlens.functions import text_exact as X
from pairlens.functions.nulls import is_value, rate, same, truthy
from pairlens.operators import audits, joins, pairs, ranking, resample, summaries


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()[0])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_null_rules(spark):
    n = F.lit(None).cast("string")
    assert one(spark, same(n, n), same(n, F.lit("a")), is_value(n, "a"), truthy(F.lit(None).cast("boolean")), rate(F.lit(1), F.lit(0)), rate(F.lit(1), F.lit(4))) == (True, False, False, False, None, 0.25)


def test_wilson_and_mcnemar(spark):
    low, high = S.wilson(F.lit(170), F.lit(175))
    got = one(spark, low, high, *S.wilson(F.lit(0), F.lit(0)), *S.wilson(F.lit(0), F.lit(5)))
    assert got[0] == pytest.approx(0.9349, abs=1e-4) and got[1] == pytest.approx(0.9877, abs=1e-4)
    assert got[2:4] == (None, None) and got[4] == 0.0
    for b, c in [(0, 0), (0, 4), (5, 1), (3, 2), (40, 60), (900, 1200), (1, 0)]:
        n = b + c
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
        assert one(spark, S.mcnemar(F.lit(b), F.lit(c)))[0] == pytest.approx(want, rel=1e-9)


def test_holm_alpha_and_cluster_error(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "d", 0.5)], "fam string, id string, p double")
    got = {r.id: r.holm_p for r in S.holm(df, "p", ["fam"], ["id"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06, "d": 0.5})
    data = {"i": [1, 2, 2], "j": [4, 5], "k": [3]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "item string, v int").withColumn("all", F.lit("x"))
    flat = [v for vs in data.values() for v in vs]
    within = [(a - b) ** 2 for vs in data.values() for a, b in combinations(vs, 2)]
    total = [(a - b) ** 2 for a, b in combinations(flat, 2)]
    want = 1 - (sum(within) / len(within)) / (sum(total) / len(total))
    assert S.interval_alpha(df, "item", "v", ["all"]).collect()[0].alpha == pytest.approx(want)
    r = S.cluster_error(df, "item", "v", ["all"]).collect()[0]
    mean = 17 / 6
    want = math.sqrt(sum(sum(v - mean for v in vs) ** 2 for vs in data.values()) * 3 / 2) / 6
    assert (r.clusters, r.n) == (3, 6) and r.error == pytest.approx(want)


def test_quantiles(spark):
    v = F.array(*[F.lit(float(x)) for x in (5, 1, 4, 2)])
    assert one(spark, S.quantile(v, 0.5), S.quantile(v, 0.5, "nearest"), S.quantile(v, 0.5, "index:3"), S.quantile(v, 1.0)) == (3.0, 4.0, 5.0, 5.0)


def test_hashes(spark):
    h = hashlib.sha256(b"s:7:x").hexdigest()
    got = one(spark, H.keyed("s", F.lit(7), "x"), H.leading(H.keyed("s", F.lit(7), "x"), 16, 97), H.whole_mod(H.keyed("s", F.lit(7), "x"), 101), H.first_bit(F.lit(h)), H.record_id(F.lit(h)), H.leading(F.lit("f" * 64), 16, 10))
    assert got == (h, int(h[:16], 16) % 97, int(h, 16) % 101, int(h[:2], 16) % 2, h[:8].upper(), (2**64 - 1) % 10)
    assert one(spark, H.slug(F.lit("a b/c!")))[0] == "a-b-c-" + hashlib.sha256(b"a b/c!").hexdigest()[:10]


def test_parsers(spark):
    opts = F.create_map(F.lit("A"), F.lit("consistent"), F.lit("B"), F.lit("inconsistent"))
    table = [
        (T.bare_option, "(b).", "B"), (T.bare_option, "B\n", "B"), (T.bare_option, "the B", None), (T.stray_choice, "so a: B", "A"), (T.stray_choice, "cab", None),
        (T.binary_answer, "Not sure, yes", "b"), (T.binary_answer, "nothing", "invalid"), (T.reasoned, "x\nFINAL: (C)", "C"), (T.reasoned, "FINAL: A\nFINAL: B", None), (T.reasoned, "FINAL: A\nmore", None),
        (T.task_verdict, 'x {"claim": "true"} {"claim": "false"}', "TRUE"), (T.task_verdict, "it is false and true", "FALSE"), (T.task_verdict, None, "NONE"), (T.side, "Right.", "R"),
        (T.normalize_answer, "The", "the"), (T.normalize_answer, "the two 1,000 cats", "2 1000 cats"), (T.normalize_claim, " A--b! ", "a b"), (T.one_number, "it is -3.5!", -3.5), (T.one_number, "1 or 2", None),
        (T.first_line, " a \nb", "a"), (T.trimmed_letter, " (b). ", "B"),
    ]
    got = one(spark, *[f(F.lit(x).cast("string")) for f, x, _ in table])
    for g, (f, x, want) in zip(got, table, strict=True):
        assert g == want, (f.__name__, x, g)
    assert one(spark, T.choice(F.lit("It is INTERNALLY inconsistent"), opts), T.choice(F.lit("B"), opts), T.choice(F.lit(None).cast("string"), opts)) == ("inconsistent", "inconsistent", None)
    strict = T.strict_object(F.col("t"), ["claim", "why", "verdict"], "verdict", ["TRUE", "FALSE"])
    good = '{"claim": "a", "why": "b", "verdict": "TRUE"}'
    df = spark.createDataFrame([(good,), (f"```json\n{good}\n```",), (good + " tail",), (good.replace('"a"', "1"),), ("{",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(strict.isNotNull()).collect()] and [r[0] for r in df.select(strict.isNotNull()).collect()] == [True, True, False, False, False, False]


def test_matchers(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, T.contains_tokens(lit("See the red Cat."), lit("red cat")), T.contains_tokens(lit("cats"), lit("cat")), T.contains_tokens(lit("x"), lit("")), T.label_match(lit("Buses"), lit("buse")), T.token_recall(lit("a b"), lit("")), T.token_recall(lit("red cat"), lit("the cat"))) == (True, False, False, True, 0.0, 0.5)
    ten = F.array(*[F.lit("no")] * 2 + [F.lit("yes")] * 8)
    assert one(spark, T.consensus_score(F.lit("No."), ten), T.consensus_score(F.lit("no"), F.slice(ten, 3, 3)))[1] == 0.0
    assert one(spark, T.consensus_score(F.lit("No."), ten))[0] == pytest.approx((2 * (1 / 3) + 8 * (2 / 3)) / 10)
    assert one(spark, T.all_present(F.lit("a b c"), F.array(F.lit("b"), F.lit("A"))), T.all_present(F.lit("a"), F.array().cast("array<string>"))) == (True, False)
    df = spark.createDataFrame([("ẞ ﬁ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.casefold("t")).collect()] == ["ss fi", None]
    assert [r[0] for r in spark.createDataFrame([("Ａ!",), ("A or B",)], "t string").select(X.conservative_choice("t", F.array(F.lit("x")))).collect()] == ["A", None]
    assert [r[0] for r in spark.createDataFrame([("a &lt;b&gt;c<br>d&amp;lt; &eacute; e",)], "t string").select(X.plain_text("t")).collect()] == ["a c d&lt; é e"]


def printed_records():
    """(text, assumption, prediction, reason, family): true and false records of all families and every reason to abstain."""
    a = R.ASSUMPTIONS
    temp = "TEMP 20.0 C | SAFE RANGE 18 TO 22 C | UNCERTAINTY +/- 0.2 C"
    unit = "SOURCE 10 C | CONVERTED 50.0 F | ROUNDING TOLERANCE +/- 0.06 F"
    clock = "START 10:00 | FINISH 11:00 | ELAPSED 60 MIN | CLOCK RESOLUTION +/- 1 MIN"
    full = "CAPACITY 8 L | ADDED 5+4 L | SPILL 1 L | UNCERTAINTY +/- 0.05 L"
    cause = "STOPPED 10:05 | BRAKE APPLIED 10:03 | CLOCK RESOLUTION +/- 1 MIN"
    wide = "RIGID WIDTH 1.20 M | OPENING 1.25 M | UNCERTAINTY +/- 0.01 M"
    prob = "P(PASS) 0.33 | P(FAIL) 0.68 | TOTAL 1.00 | ROUNDING +/- 0.01"
    ice = "TEMP -3.0 C | PRESSURE 1.00 ATM | STATE SOLID ICE | UNCERTAINTY +/- 0.2 C / +/- 0.01 ATM"
    celsius = "Both fields describe the same quantity; use F=(9/5)C+32."
    out = []
    for f, text, wrong in [
        ("range_threshold", temp, ("20.0", "21.9")), ("temporal_ledger", clock, ("11:00", "11:02")), ("capacity_conservation", full, ("SPILL 1", "SPILL 0")),
        ("causal_order", cause, ("10:03", "10:07")), ("geometry_feasibility", wide, ("1.25", "1.18")), ("probability_ledger", prob, ("0.68", "0.69")), ("phase_state", ice, ("SOLID ICE", "LIQUID WATER")),
    ]:
        out += [(text, a[f], "consistent", None, f), (text.replace(*wrong), a[f], "inconsistent", None, f), (text + " | VERIFIED CORRECT", a[f], "consistent", None, f)]
        out += [(text, "Something else.", None, "unsupported_assumptions", f), (text, None, None, "unsupported_assumptions", f)]
        for label, pattern in R.FIELDS[f]:  # every field left out, and printed twice
            segment = next(x for x in text.split(" | ") if re.search(pattern, x))
            if R.MARKERS[f] not in segment:
                out.append((text.replace(segment, "").replace("|  |", "|"), a[f], None, f"missing_or_duplicate_{label}", f))
            out.append((f"{text} | {segment}", a[f], None, f"missing_or_duplicate_{label}", f))
    out += [(unit, celsius, "consistent", None, "unit_conversion"), (unit.replace("50.0", "50.1"), celsius, "inconsistent", None, "unit_conversion"), (unit, a["causal_order"], None, "unsupported_assumptions", "unit_conversion")]
    out += [("source 5 km | converted 3.106855 mi | rounding tolerance ± 0.000001 mi", "Both fields describe the same quantity; use mi=0.621371*km.", "consistent", None, "unit_conversion")]
    out += [("SOURCE 1 KG | CONVERTED 2.2 LB | ROUNDING TOLERANCE +/- .005 LB", "Both fields describe the same quantity; use lb=2.2046226218*kg.", "consistent", None, "unit_conversion")]
    out += [("SOURCE 10 C | CONVERTED 50 MI | ROUNDING TOLERANCE +/- 0.06 MI", celsius, None, "unsupported_units", "unit_conversion"), (unit.replace("0.06 F", "0.06 MI"), celsius, None, "missing_or_duplicate_tolerance", "unit_conversion")]
    out += [(temp.replace("18 TO 22", "22 TO 18"), a["range_threshold"], None, "reversed_range", "range_threshold"), (temp.replace("+/- 0.2", "+/- -0.2"), a["range_threshold"], None, "negative_tolerance", "range_threshold")]
    out += [(clock.replace("11:00", "25:00"), a["temporal_ledger"], None, "invalid_clock", "temporal_ledger"), (clock.replace("ELAPSED 60", "ELAPSED -60"), a["temporal_ledger"], "inconsistent", None, "temporal_ledger")]
    out += [(ice.replace("-3.0", "+000.1"), a["phase_state"], None, "unsupported_phase_boundary_or_pressure", "phase_state"), (ice.replace("1.00 ATM", "1.10 ATM"), a["phase_state"], None, "unsupported_phase_boundary_or_pressure", "phase_state")]
    out += [(ice.replace("-3.0", "−3.0").replace("+/-", "±").lower(), a["phase_state"], "consistent", None, "phase_state"), (full.replace("CAPACITY 8", "CAPACITY 8.123456789"), a["capacity_conservation"], None, "unsupported_number", "capacity_conservation")]
    out += [(full.replace("8 L |", "8 L. |"), a["capacity_conservation"], None, "missing_or_duplicate_capacity", "capacity_conservation")]
    return [*out, (f"{unit} | CAPACITY 8 L", "", None, "unknown_or_multiple_schemas", None), ("no record", "", None, "unknown_or_multiple_schemas", None), (None, None, None, "unknown_or_multiple_schemas", None)]


def test_record_checker(spark):
    rows = printed_records()
    df = spark.createDataFrame([(k, t, a) for k, (t, a, *_) in enumerate(rows)], "k int, t string, a string")
    got = [(r.check.prediction, r.check.reason, r.check.family) for r in R.checked(df, "t", "a").orderBy("k").collect()]
    for row, g in zip(rows, got, strict=True):
        assert g == row[2:], row
    assert {f for *_, f in rows} == {*R.MARKERS, None}
    seen = R.checked(df, "t", "a").where("k = 0").collect()[0].check.extracted
    assert seen == {"temperature": ["20.0"], "range": ["18", "22"], "tolerance": ["0.2"]}


def test_residuals_and_derived_values(spark):
    rows = [
        ("TEMP 25.0 C | SAFE RANGE 18 TO 22 C", "temperature-safe-range", None, 3.2), ("TEMP -25.0 C | SAFE RANGE -18 TO 22 C", "temperature-safe-range-v2", "UNCERTAINTY +/- 0.5 C", 7.5),
        ("SOURCE 10 C | CONVERTED 51 F", "celsius-fahrenheit-conversion", None, 1.0), ("SOURCE -10 C | CONVERTED 14 F", "celsius-fahrenheit-conversion-v2", None, 0.0),
        ("SOURCE 10 KM | CONVERTED 6 MI", "kilometer-mile-conversion-v2", None, 6 - 6.21371), ("START 10:00 | FINISH 11:30 | ELAPSED 80 MIN", "start-finish-elapsed-time", None, 10.0),
        ("CAPACITY 8 L | ADDED 5+4 L | SPILL 0 L", "capacity-addition-spill-balance", None, 1.0), ("STOPPED 10:05 | BRAKE APPLIED 10:09", "cause-precedes-effect", None, 4.0),
        ("RIGID WIDTH 1.5 M | OPENING 1.25 M", "rigid-width-opening-clearance-v2", None, 0.25), ("P(PASS) 0.5 | P(FAIL) 0.75 | TOTAL 1.00", "exclusive-exhaustive-probability-sum", None, 0.25),
        ("TEMP 50 C | PRESSURE 1.00 ATM | STATE SOLID ICE", "water-phase-at-temperature-pressure", None, 1.0), ("TEMP -5 C | PRESSURE 1.00 ATM | STATE SOLID ICE", "water-phase-at-temperature-pressure-v2", None, 0.0),
        ("nothing", "kilometer-mile-conversion-v2", None, None), ("TEMP 5", "other", None, None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, s string, u string, want double")
    for r in df.withColumn("got", R.residual(F.col("t"), F.col("s"), F.col("u"))).collect():
        assert r.got is None if r.want is None else r.got == pytest.approx(r.want), r
    lines = [
        ("unit_conversion", ["SOURCE 10 KG", "DESTINATION UNIT LB"], "22.05 LB"), ("unit_conversion", ["SOURCE 2 L", "DESTINATION UNIT GAL"], "0.53 GAL"), ("unit_conversion", ["SOURCE 2 L", "DESTINATION UNIT F"], None),
        ("temporal_ledger", ["START 10:00", "FINISH 11:07"], "67 MIN"), ("temporal_ledger", ["START 10:00", "FINISH 24:07"], None), ("capacity_conservation", ["CAPACITY 8 L", "ADDED FIRST 5 L", "ADDED SECOND 4.25 L"], "1.2 L"),
        ("capacity_conservation", ["CAPACITY 9.5 L", "ADDED FIRST 5 L", "ADDED SECOND 4.25 L"], None), ("causal_order", ["STOPPED 10:05", "BRAKE APPLIED 10:05"], "AT THE SAME TIME"), ("causal_order", ["STOPPED 10:05", "BRAKE APPLIED 10:02"], "BEFORE THE STOP"),
        ("geometry_feasibility", ["RIGID WIDTH 1.2 M", "OPENING 1.3 M"], "0.00 M"), ("range_threshold", ["TEMP 25 C", "UNCERTAINTY +/- 0.2 C", "SAFE LOWER 18 C", "SAFE UPPER 22 C"], "3.2 C"),
        ("probability_ledger", ["P(PASS) 0.405", "P(FAIL) 0.2"], "0.60"), ("phase_state", ["TEMP 120 C", "PRESSURE 1.00 ATM"], "WATER VAPOR"), ("phase_state", ["TEMP 100 C", "PRESSURE 1.00 ATM"], None), (None, ["x"], None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(lines)], "k int, f string, lines array<string>, want string")
    for r in df.withColumn("got", R.derived_value(F.col("f"), F.col("lines"))).collect():
        assert r.got == r.want, r
    panels = spark.createDataFrame([(["START MASS 100 G", "REMOVED 20.5 G | ADDED 5 G", "FINAL MASS 90 G"],), (["START MASS 100 G"],)], "p array<string>")
    assert [r[0] for r in panels.select(R.mass_residual(F.col("p"))).collect()] == [5.5, None]
    assert one(spark, R.separation(F.lit(3.0), F.lit(0.0), F.lit(1.0), [F.lit("VALID x")], "VALID"), R.separation(F.lit(1.0), F.lit(0.0), F.lit(1.0), [F.lit("x")], "VALID"), R.separation(F.lit(3.0), F.lit(2.0), F.lit(1.0), [F.lit("x")], "V"), R.separation(F.lit(3.0), F.lit(-1.0), F.lit(1.0), [F.lit(None).cast("string")], "V")) == ("leaks_answer", "false_within_tolerance", "true_exceeds_tolerance", None)


def test_double_control_with_nulls_and_empty_groups(spark):
    def item(i, a, t, f, read, know):
        return [("m", i, "source_absent", a, None, None), ("m", i, "record_true", t, None, None), ("m", i, "record_false", f, read, know)]

    data = item(1, "absent", "consistent", "consistent", True, "inconsistent") + item(2, "absent", "consistent", None, None, None) + item(3, None, "consistent", "consistent", True, None)
    df = spark.createDataFrame(data, "model string, item_id int, condition string, decide string, read_match boolean, knowledge string")
    for part in (1, 4):
        r = pairs.double_control(df.repartition(part), ["model"]).collect()[0]
        assert (r.dc_n, r.dc_k, r.eor_n, r.eor_k) == (2, 1, 1, 1)
    r = pairs.double_control(df.where("item_id = 3"), ["model"]).collect()[0]
    assert (r.dc_n, r.dc_rate, r.dc_low) == (0, None, None)


def test_ranking(spark):
    df = spark.createDataFrame([(k, f"g{k % 3}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(40)], "id int, g string, h string")
    want = {i: n for n, (_, i) in enumerate(sorted((hashlib.sha256(str(k).encode()).hexdigest(), k) for k in range(40)))}
    assert {r.id: r["rank"] for r in ranking.ranked(df.repartition(5), ["h", "id"]).collect()} == want
    got = ranking.allocate(df, [("a", F.col("g") == "g0", 3), ("b", F.lit(True), 4)], "id", ["h", "id"]).collect()
    assert len({r.id for r in got}) == 7 and [r.family for r in got] == ["a"] * 3 + ["b"] * 4
    cover = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2), ("r", 3)], "policy string, item int")
    assert [tuple(r) for r in ranking.greedy_cover(cover, "policy", "item", 5).orderBy("place").collect()] == [(0, "q", 2), (1, "r", 1)]
    assert one(spark, ranking.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4)), ranking.splits(F.lit(5), [("x", 3), ("y", 2)], "z")) == ([2, 3, 1], "z")


def test_audits_find_each_mutation(spark):
    good = spark.createDataFrame([(i, c, "f", None) for i in (1, 2) for c in ("a", "b")], "item int, cond string, fam string, note string")
    assert rows(audits.coverage(good, good, ["item", "cond"])) == [] == rows(audits.drift(good, good, ["item", "cond"], ["fam", "note"]))
    bad = good.where("not (item = 1 and cond = 'a')").unionByName(spark.createDataFrame([(2, "b", "g", "n"), (3, "a", "f", None)], good.schema))
    assert {(r.rule, r.key) for r in audits.coverage(good, bad, ["item", "cond"]).collect()} == {("missing", "1|a"), ("duplicate", "2|b"), ("extra", "3|a")}
    assert {(r.key, r.detail) for r in audits.drift(good, bad, ["item", "cond"], ["fam", "note"]).collect()} == {("2|b", "fam"), ("2|b", "note")}
    assert len(rows(audits.factorial(bad, ["item"], "cond", ["a", "b"]))) == 3
    assert {r.detail for r in audits.invariance(bad, ["item"], ["fam", "note"]).collect()} == {"fam", "note"}
    calls = spark.createDataFrame([("x", "call_started", 1, "p"), ("x", "call_finished", 2, "p"), ("y", "call_started", 5, "p"), ("y", "call_finished", 3, "q"), ("z", "call_started", 1, "p")], "c string, k string, t int, prompt string")
    assert {(r.rule, r.key) for r in audits.journal(calls, "c", "k", "t", ["prompt"]).collect()} == {("time", "y"), ("field prompt", "y"), ("finishes", "z")}
    seq = [(1, 1, "decision", 7, False), (1, 2, "read", 7, True), (2, 1, "read", 7, False), (2, 3, "decision", 7, False), (3, 1, "decision", 7, True), (3, 2, "read", 8, False), (4, 1, "decision", 7, False), (4, 1, "decision", 7, False), (4, 2, "read", 7, False)]
    seq = spark.createDataFrame(seq, "i int, n int, k string, c int, s boolean")
    assert sorted((r.rule, r.key) for r in audits.adjacency(seq, ["i"], "n", "k", "c", "s", 2).collect()) == sorted([
        ("read_order", "2|1"), ("index", "2|3"), ("after_success", "3|1"), ("read_order", "3|2"), ("duplicate", "4|1"), ("duplicate", "4|1"), ("index", "4|1"), ("index", "4|2"), ("budget", "4|2"),
    ])
    assert one(spark, audits.one_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3))), audits.one_difference(F.array(F.lit(1)), F.array(F.lit(1))))  == (True, False)


def test_joins_and_summaries(spark):
    left = spark.createDataFrame([("s", 10, 1), ("s", 50, 2)], "k string, m int, id int")
    right = spark.createDataFrame([("s", 8, "early"), ("s", 12, "late"), ("s", 58, "far"), ("t", 10, "other")], "k string, m2 int, name string")
    got = joins.nearest_in_time(left, right, ["k"], "m", "m2", 5, ["name"]).select("id", "name")
    assert rows(got) == [(1, "early")]
    assert one(spark, F.round(joins.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 3))[0] == round(math.pi * joins.EARTH_KM, 3)
    e = spark.createDataFrame([(1, 1, False, "a"), (1, 2, True, "b"), (2, 1, False, "c")], "i int, r int, ok boolean, f string")
    t = {r.i: (r.first_success, r.outcome, r.feedback) for r in summaries.terminal_rows(e, "i", "r", F.col("ok"), "f", 1).collect()}
    assert t == {1: (2, "success", ["a", "b"]), 2: (None, "budget_exhausted", ["c"])}
    b = rows(summaries.success_budgets(e, [], "i", "r", F.col("ok"), [1, 3]))
    assert b == [(1, 2, 0, 1.0), (3, 2, 1, 2.5)]


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k % 2, k, float(k * k % 17)) for k in range(30)], "g int, id int, v double")
    a = rows(resample.intervals(resample.bootstrap_means(df.repartition(1), ["g"], "id", "v", 40, 3), ["g"]))
    b = rows(resample.intervals(resample.bootstrap_means(df.repartition(7), ["g"], "id", "v", 40, 3), ["g"]))
    assert a == b and all(lo <= m <= hi for _, _, lo, hi, m in a)
    assert len(rows(resample.cluster_means(df, ["g"], "id", "v", 10, 3))) == 2


def test_bitmap_cover_equals_the_plain_greedy_choice(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), rng.randrange(200_000) if rng.random() < 0.5 else rng.randrange(60)) for _ in range(400)] + [(3, 7), (3, 7), (None, 1), (2, None)]
    own = {}
    for p, i in rows:
        if p is not None and i is not None:
            own.setdefault(p, set()).add(i)
    want, seen = [], set()
    for place in range(5):
        gain, p = max((len(v - seen), p) for p, v in own.items() if p not in [x[1] for x in want])
        want.append((place, p, gain))
        seen |= own[p]
    df = spark.createDataFrame(rows, "policy long, item long").repartition(4)
    assert [tuple(r) for r in ranking.bitmap_cover(df, "policy", "item", 5).orderBy("place").collect()] == want
    assert ranking.bitmap_cover(df.where("policy > 99"), "policy", "item", 5).count() == 0


def test_severities_that_are_equal_or_out_of_order(spark):
    df = spark.createDataFrame([(1, 10.0, 11.0, 12.0, 14.0), (2, 10.0, 10.04, 12.0, 14.0), (3, 10.0, 12.0, 11.0, 14.0), (4, 10.0, 11.0, None, 14.0), (5, 10.0, 8.0, 13.0, 6.0)], "k int, t double, a double, b double, c double")
    assert sorted(map(tuple, audits.severity(df, ["k"], "t", ["a", "b", "c"]).collect())) == [("equal", "2", "a"), ("order", "3", ""), ("order", "4", "")]
