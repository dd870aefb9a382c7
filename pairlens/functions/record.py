"""Checker of printed records: exact decimals, eight families, consistent, inconsistent or abstain.

A text is upper-cased, minus and plus-minus signs are unified, white space is
collapsed.  Exactly one family marker and every field exactly once are needed, and
the stated assumption must be the registered one; otherwise the checker abstains
with the first reason.  Fields, clocks, units and states are read by the family's
own patterns; a pattern runs only on records of its family.

Defined cases: a null text is the text NONE; numbers with more than eleven digits
before or eight behind the point abstain as unsupported_number; only ASCII digits
are digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.text import let

N = r"([+-]?(?:\d+(?:\.\d+)?|\.\d+))"
DECIMAL = "decimal(19,8)"

# Markers, printed field formats in reading order, assumptions, conversions and reasons of the record format.
MARKERS = {
    "range_threshold": "SAFE RANGE",
    "unit_conversion": "CONVERTED",
    "temporal_ledger": "ELAPSED",
    "capacity_conservation": "CAPACITY",
    "causal_order": "BRAKE APPLIED",
    "geometry_feasibility": "RIGID WIDTH",
    "probability_ledger": "P(PASS)",
    "phase_state": "PRESSURE",
}
ASSUMPTIONS = {
    "range_threshold": "The measurement interval and safe interval use degrees Celsius; the complete uncertainty interval must lie inside the inclusive safe range.",
    "temporal_ledger": "All times are same-day 24-hour local times with no date rollover.",
    "capacity_conservation": "The container starts empty; no liquid is lost except the recorded spill; final fill is at capacity.",
    "causal_order": "The stated initiating event is the direct cause and both timestamps use one synchronized timeline.",
    "geometry_feasibility": "Widths use the same direction; the object is rigid and neither rotates nor deforms.",
    "probability_ledger": "A and B are the only outcomes and cannot occur together; probabilities are exact to 0.01.",
    "phase_state": "The sample is pure water at equilibrium at 1.00 atm, without supercooling or dissolved solutes.",
}
CONVERSION_ASSUMPTION = "Both fields describe the same quantity; use {}."
#: (source unit, target unit): formula, factor, offset.
CONVERSIONS = {
    ("C", "F"): ("F=(9/5)C+32", "1.8", "32"),
    ("KM", "MI"): ("mi=0.621371*km", "0.621371", "0"),
    ("KG", "LB"): ("lb=2.2046226218*kg", "2.2046226218", "0"),
    ("L", "USGAL"): ("USgal=0.2641720524*L", "0.2641720524", "0"),
}
CLOCK = r"\s+(\d{2}):(\d{2})"
#: Family: (label, pattern) of each field; the groups of a pattern are the field's values.
FIELDS = {
    "range_threshold": [("temperature", rf"TEMP\s+{N}\s+C"), ("range", rf"SAFE RANGE\s+{N}\s+TO\s+{N}\s+C"), ("tolerance", rf"UNCERTAINTY\s+\+/-\s*{N}\s+C")],
    "unit_conversion": [("source", rf"SOURCE\s+{N}\s+(C|KM|KG|L)"), ("converted", rf"CONVERTED\s+{N}\s+(F|MI|LB|USGAL)"), ("tolerance", rf"ROUNDING TOLERANCE\s+\+/-\s*{N}\s+")],
    "temporal_ledger": [("START", "START" + CLOCK), ("FINISH", "FINISH" + CLOCK), ("elapsed", rf"ELAPSED\s+{N}\s+MIN"), ("tolerance", rf"CLOCK RESOLUTION\s+\+/-\s*{N}\s+MIN")],
    "capacity_conservation": [("capacity", rf"CAPACITY\s+{N}\s+L"), ("added", rf"ADDED\s+{N}\s*\+\s*{N}\s+L"), ("spill", rf"SPILL\s+{N}\s+L"), ("tolerance", rf"UNCERTAINTY\s+\+/-\s*{N}\s+L")],
    "causal_order": [("STOPPED", "STOPPED" + CLOCK), ("BRAKE APPLIED", "BRAKE APPLIED" + CLOCK), ("tolerance", rf"CLOCK RESOLUTION\s+\+/-\s*{N}\s+MIN")],
    "geometry_feasibility": [("width", rf"RIGID WIDTH\s+{N}\s+M"), ("opening", rf"OPENING\s+{N}\s+M"), ("tolerance", rf"UNCERTAINTY\s+\+/-\s*{N}\s+M")],
    "probability_ledger": [("pass", rf"P\(PASS\)\s+{N}"), ("fail", rf"P\(FAIL\)\s+{N}"), ("total", rf"TOTAL\s+{N}"), ("tolerance", rf"ROUNDING\s+\+/-\s*{N}")],
    "phase_state": [("temperature", rf"TEMP\s+{N}\s+C"), ("pressure", rf"PRESSURE\s+{N}\s+ATM"), ("state", r"STATE\s+(SOLID ICE|LIQUID WATER|WATER VAPOR)"), ("tolerances", rf"UNCERTAINTY\s+\+/-\s*{N}\s+C\s*/\s*\+/-\s*{N}\s+ATM")],
}
CLOCKS = {"START", "FINISH", "STOPPED", "BRAKE APPLIED"}
TEXTS = {("unit_conversion", "source", 1), ("unit_conversion", "converted", 1), ("phase_state", "state", 0)}


def prepared(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("None")))
    return F.trim(F.regexp_replace(F.replace(F.replace(t, F.lit("−"), F.lit("-")), F.lit("±"), F.lit("+/-")), r"(?U)\s+", " "))


def family_of(prepared_text: Column) -> Column:
    """The one family whose marker is in the text, else null."""
    found = F.array_compact(F.array(*[F.when(prepared_text.contains(m), F.lit(f)) for f, m in MARKERS.items()]))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def _hit(text: Column, pattern: str) -> Column:
    """Groups of the only match of a field's pattern; null if there is none or more than one."""
    whole = rf"(?<![A-Z0-9_])(?:{pattern})(?![A-Z0-9_.])"
    groups = pattern.replace(r"\(", "").replace("(?:", "").count("(")
    return F.when(F.regexp_count(text, F.lit(whole)) == 1, F.array(*[F.regexp_extract(text, whole, k + 1) for k in range(groups)]))


def _slot(family: Column, text: Column, k: int) -> Column:
    """The k-th field of whatever family the record has."""
    out = F.lit(None).cast("array<string>")
    for f, fields in FIELDS.items():
        if k >= len(fields):
            continue
        if (f, fields[k][0]) == ("unit_conversion", "tolerance"):  # in the unit of the converted value
            unit, own = F.get(F.col("__s1"), F.lit(1)), F.lit(None).cast("array<string>")
            for _, u in CONVERSIONS:
                own = F.when(unit == u, _hit(text, fields[k][1] + u)).otherwise(own)
        else:
            own = _hit(text, fields[k][1])
        out = F.when(family == f, own).otherwise(out)
    return out


def checked(df: DataFrame, text: str, assumption: str, out: str = "check") -> DataFrame:
    """df with struct<family, prediction, reason, extracted>; prediction is null where the checker abstains.

    extracted has the printed values of the fields up to the first reason.
    """
    most = max(map(len, FIELDS.values()))
    slots = [f"__s{k}" for k in range(most)]
    d = df.withColumn("__t", prepared(F.col(text)))
    d = d.withColumn("__family", family_of(F.col("__t")))
    d = d.withColumns({slots[k]: _slot(F.col("__family"), F.col("__t"), k) for k in range(2)})
    d = d.withColumns({slots[k]: _slot(F.col("__family"), F.col("__t"), k) for k in range(2, most)})
    family, said = F.col("__family"), F.col(assumption)
    steps = {f: _steps(f, said) for f in FIELDS}
    reason = F.when(family.isNull(), F.lit("unknown_or_multiple_schemas"))
    valid = F.lit(None).cast("boolean")
    for f, (checks, holds) in steps.items():
        own = reduce(lambda a, x: a.when(x[0], F.lit(x[1])), checks[1:], F.when(checks[0][0], F.lit(checks[0][1])))
        reason = reason.when(family == f, own)
        valid = F.when(family == f, holds).otherwise(valid)
    d = d.withColumn("__reason", reason)
    prediction = F.when(F.col("__reason").isNull(), F.when(valid, "consistent").otherwise("inconsistent"))
    # a field counts as extracted until a field before it, or the assumption, stopped the reading
    names = F.lit(None).cast("array<string>")
    for f, fields in FIELDS.items():
        names = F.when(family == f, F.array(*[F.lit(label) for label, _ in fields])).otherwise(names)
    read = F.array(*[F.struct(F.try_element_at(names, F.lit(k + 1)).alias("key"), F.col(s).alias("value")) for k, s in enumerate(slots)])
    stop = F.coalesce(F.array_position(F.transform(read, lambda x: x["value"].isNull()), True), F.lit(0))
    read = F.when(stop > 0, F.slice(read, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(read)
    early = F.col("__reason").isin("unknown_or_multiple_schemas") | ((F.col("__reason") == "unsupported_assumptions") & (family != "unit_conversion"))
    two = F.col("__reason").isin("unsupported_units", "unsupported_assumptions")
    one = (F.col("__reason") == "invalid_clock") & ~_minute_ok(F.col("__s0"))
    read = F.when(early, F.slice(read, 1, 0)).when(one, F.slice(read, 1, 1)).when(two | (F.col("__reason") == "invalid_clock"), F.slice(read, 1, 2)).otherwise(read)
    d = d.withColumn(out, F.struct(family.alias("family"), prediction.alias("prediction"), F.col("__reason").alias("reason"), F.map_from_entries(read).alias("extracted")))
    return d.drop("__t", "__family", "__reason", *slots)


def _minute_ok(hit: Column) -> Column:
    return (F.get(hit, F.lit(0)).try_cast("int") <= 23) & (F.get(hit, F.lit(1)).try_cast("int") <= 59)


def _steps(family: str, said: Column) -> tuple[list[tuple[Column, str]], Column]:
    """(condition, reason) in reading order, and whether a readable record of the family is consistent."""
    checks: list[tuple[Column, str]] = []
    v: dict[str, list[Column]] = {}
    if family != "unit_conversion":
        checks.append((~said.eqNullSafe(F.lit(ASSUMPTIONS[family])), "unsupported_assumptions"))
    for k, (label, _) in enumerate(FIELDS[family]):
        hit = F.col(f"__s{k}")
        if (family, label) == ("unit_conversion", "tolerance"):
            pair = F.concat_ws(">", v["source"][1], v["converted"][1])
            checks.append((~pair.isin(*[">".join(p) for p in CONVERSIONS]), "unsupported_units"))
            formula = reduce(lambda a, p: a.when(pair == ">".join(p[0]), F.lit(CONVERSION_ASSUMPTION.format(p[1][0]))), CONVERSIONS.items(), F.when(F.lit(False), F.lit("")))
            checks.append((~said.eqNullSafe(formula), "unsupported_assumptions"))
        checks.append((hit.isNull(), f"missing_or_duplicate_{label}"))
        if label in CLOCKS:
            checks.append((~_minute_ok(hit), "invalid_clock"))
            v[label] = [F.get(hit, F.lit(0)).try_cast("int") * 60 + F.get(hit, F.lit(1)).try_cast("int")]
            continue
        groups = 1 + (label in ("range", "added", "tolerances", "source", "converted"))
        v[label] = [F.get(hit, F.lit(g)) if (family, label, g) in TEXTS else F.get(hit, F.lit(g)).try_cast(DECIMAL) for g in range(groups)]
        for g in range(groups):
            if (family, label, g) not in TEXTS:
                checks.append((~F.get(hit, F.lit(g)).rlike(r"\A[+-]?\d{0,11}(?:\.\d{1,8})?\z"), "unsupported_number"))
        if label == "tolerance":
            checks.append((v[label][0] < 0, "negative_tolerance"))
    u = v["tolerance"][0] if "tolerance" in v else None
    if family == "range_threshold":
        (t,), (low, high) = v["temperature"], v["range"]
        checks.append((low > high, "reversed_range"))
        return checks, (low <= t - u) & (t + u <= high)
    if family == "unit_conversion":
        (source, unit), (target, other) = v["source"], v["converted"]
        gap = F.lit(None).cast("decimal(38,18)")
        for (a, b), (_, factor, offset) in CONVERSIONS.items():
            gap = F.when((unit == a) & (other == b), F.abs(source * F.lit(factor).cast("decimal(11,10)") + F.lit(offset).cast("decimal(2,0)") - target)).otherwise(gap)
        return checks, gap <= u
    if family == "temporal_ledger":
        took = v["elapsed"][0]
        return checks, (took >= 0) & (v["FINISH"][0] >= v["START"][0]) & (F.abs(v["FINISH"][0] - v["START"][0] - took) <= u)
    if family == "capacity_conservation":
        (a, b), (spill,), (full,) = v["added"], v["spill"], v["capacity"]
        return checks, (F.least(full, a, b, spill) >= 0) & (F.abs(a + b - spill - full) <= u)
    if family == "causal_order":
        return checks, (v["BRAKE APPLIED"][0] - v["STOPPED"][0]).cast("decimal(10,0)") <= u
    if family == "geometry_feasibility":
        width, opening = v["width"][0], v["opening"][0]
        return checks, (F.least(width, opening) >= 0) & (width - opening <= u)
    if family == "probability_ledger":
        a, b, total = v["pass"][0], v["fail"][0], v["total"][0]
        return checks, a.between(0, 1) & b.between(0, 1) & (total == 1) & (F.abs(a + b - total) <= u)
    t, p, (u, pu) = v["temperature"][0], v["pressure"][0], v["tolerances"]
    near = lambda x: (t - u <= x) & (t + u >= x)
    checks.append(((p != 1) | (F.least(u, pu) < 0) | near(0) | near(100), "unsupported_phase_boundary_or_pressure"))
    return checks, v["state"][0] == F.when(t < 0, "SOLID ICE").when(t > 100, "WATER VAPOR").otherwise("LIQUID WATER")


def residual(text: Column, scenario: Column, uncertainty: Column | None = None) -> Column:
    """How far the printed fields of a record break the rule of its scenario; null where fields are missing.

    Scenarios of the first kind assume an uncertainty of 0.2 degrees; those whose
    name ends in -v2 take the first number of `uncertainty`.
    """
    found = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    values = lambda t, sign: F.transform(found(t, rf"(?<![A-Za-z]){sign}\d+(?:\.\d+)?"), lambda x: x.cast("double"))
    minutes = lambda t: F.transform(found(t, r"\b\d{2}:\d{2}\b"), lambda x: F.substring(x, 1, 2).cast("int") * 60 + F.substring(x, 4, 2).cast("int"))
    u = F.regexp_extract(F.coalesce(uncertainty if uncertainty is not None else F.lit(""), F.lit("")), r"\d+(?:\.\d+)?", 0).try_cast("double")
    reads = {"n": lambda t: values(t, ""), "s": lambda t: values(t, "[-+]?"), "c": minutes}

    def ruled(t: Column) -> Column:
        """The rule of the scenario over the one kind of values that it reads; the others are not looked for."""
        out = F.lit(None).cast("double")
        for name, (kind, rule) in _rules(t, u).items():
            out = F.when(scenario == name, let(reads[kind](t), rule)).otherwise(out)
        return out

    return let(F.coalesce(text, F.lit("")), ruled)


def _rules(t: Column, u: Column) -> dict[str, tuple[str, Callable[[Column], Column]]]:
    """Scenario: which values of the text its rule reads (numbers n, signed numbers s, clocks c in minutes), and the rule."""
    at = lambda x, k: F.try_element_at(x, F.lit(k + 1))
    outside = lambda x, e: F.greatest(F.lit(0.0), at(x, 0) + e - at(x, 2), at(x, 1) - (at(x, 0) - e))
    celsius = lambda x: at(x, 1) - (1.8 * at(x, 0) + 32.0)
    scaled = lambda factor: lambda x: at(x, 1) - at(x, 0) * factor
    elapsed = F.regexp_extract(t, r"ELAPSED\s+(\d+)\s+MIN", 1).try_cast("int")
    took = lambda x: (at(x, 1) - at(x, 0) - elapsed).cast("double")
    after = lambda x: F.greatest(F.lit(0), at(x, 1) - at(x, 0)).cast("double")
    balance = lambda x: at(x, 1) + at(x, 2) - at(x, 3) - at(x, 0)
    room = lambda x: F.greatest(F.lit(0.0), at(x, 0) - at(x, 1))
    total = lambda x: at(x, 0) + at(x, 1) - at(x, 2)
    first_state = lambda x: F.when((at(x, 0) > 0) & (at(x, 0) < 100) & (F.abs(at(x, 1) - 1) <= 0.01) & t.contains("STATE LIQUID WATER"), 0.0).otherwise(1.0)
    state = lambda x: F.when(at(x, 0) <= 0, "SOLID ICE").when(at(x, 0) < 100, "LIQUID WATER").otherwise("WATER VAPOR")
    # fixed names and conversion factors of the scenarios
    return {
        "temperature-safe-range": ("n", lambda x: outside(x, F.lit(0.2))),
        "temperature-safe-range-v2": ("s", lambda x: outside(x, u)),
        "celsius-fahrenheit-conversion": ("n", celsius),
        "celsius-fahrenheit-conversion-v2": ("s", celsius),
        "kilometer-mile-conversion-v2": ("s", scaled(0.621371)),
        "kilogram-pound-conversion-v2": ("s", scaled(2.2046226218)),
        "liter-usgallon-conversion-v2": ("s", scaled(0.2641720524)),
        "start-finish-elapsed-time": ("c", lambda x: F.when(F.size(x) == 2, took(x))),
        "start-finish-elapsed-time-v2": ("c", took),
        "capacity-addition-spill-balance": ("n", balance),
        "capacity-addition-spill-balance-v2": ("s", balance),
        "cause-precedes-effect": ("c", lambda x: F.when(F.size(x) == 2, after(x))),
        "cause-precedes-effect-v2": ("c", lambda x: F.when(F.size(x) >= 2, after(x))),
        "rigid-width-opening-clearance": ("n", room),
        "rigid-width-opening-clearance-v2": ("s", room),
        "exclusive-exhaustive-probability-sum": ("n", total),
        "exclusive-exhaustive-probability-sum-v2": ("s", total),
        "water-phase-at-temperature-pressure": ("n", lambda x: F.when(at(x, 1).isNotNull(), first_state(x))),
        "water-phase-at-temperature-pressure-v2": ("s", lambda x: F.when(F.abs(at(x, 1) - 1) > 0.011, 1.0).when(at(x, 1).isNotNull(), F.when(t.contains(F.concat(F.lit("STATE "), state(x))), 0.0).otherwise(1.0))),
    }


def separation(false_residual: Column, true_residual: Column, tolerance: Column, texts: list[Column], banned: str) -> Column:
    """The first reason why a record and its corrected twin are not apart, null if they are."""
    leak = reduce(lambda a, t: a | F.coalesce(t, F.lit("")).rlike(banned), texts, F.lit(False))
    return F.when(F.abs(false_residual) <= tolerance, "false_within_tolerance").when(F.abs(true_residual) > tolerance, "true_exceeds_tolerance").when(leak, "leaks_answer")


#: Fields of the ledger that is spread over three panels (fixed values).
MASSES = ["START MASS", "REMOVED", "ADDED", "FINAL MASS"]


def mass_residual(panels: Column) -> Column:
    """FINAL - (START - REMOVED + ADDED) over an array of panels; null unless all four masses are printed; the last print counts."""
    last = lambda text, name: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"{name}\s+(\d+(?:\.\d+)?)\s+G"), F.lit(1)), F.lit(-1)).cast("double")

    def gap(text: Column) -> Column:
        start, removed, added, final = (last(text, name) for name in MASSES)
        return final - (start - removed + added)

    return let(F.array_join(panels, " | "), gap)


def derived_value(family: Column, lines: Column) -> Column:
    """Text of the value that the printed input lines (array) imply; null where a field is missing, doubled or out of bounds."""

    def printed(text: Column, label: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Z0-9_]){label}\s*([-+]?\d+(?:\.\d+)?)"), F.lit(1))
        return let(found, lambda x: F.when(F.size(x) == 1, F.element_at(x, 1).try_cast(DECIMAL)))

    def clock(text: Column, label: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"{label}\s+(\d{{2}}:\d{{2}})(?=\s|\z)"), F.lit(1))
        h, m = (lambda x: F.substring(F.element_at(x, 1), 1, 2).cast("int")), (lambda x: F.substring(F.element_at(x, 1), 4, 2).cast("int"))
        return let(found, lambda x: F.when(F.size(x) == 1, F.when((h(x) <= 23) & (m(x) <= 59), h(x) * 60 + m(x))))

    def unit(text: Column, label: str) -> Column:
        return F.regexp_extract(text, label + r"\s+([A-Z]+)", 1)

    #: Fields of each family: how each is read, and its label.
    fields = {
        "unit_conversion": {"source": (printed, "SOURCE"), "unit": (unit, r"SOURCE\s+[-+]?\d+(?:\.\d+)?"), "goal": (unit, "DESTINATION UNIT")},
        "temporal_ledger": {"start": (clock, "START"), "finish": (clock, "FINISH")},
        "capacity_conservation": {"full": (printed, "CAPACITY"), "first": (printed, "ADDED FIRST"), "second": (printed, "ADDED SECOND")},
        "causal_order": {"brake": (clock, "BRAKE APPLIED"), "stopped": (clock, "STOPPED")},
        "geometry_feasibility": {"width": (printed, "RIGID WIDTH"), "opening": (printed, "OPENING")},
        "range_threshold": {"t": (printed, "TEMP"), "u": (printed, r"UNCERTAINTY \+/-"), "low": (printed, "SAFE LOWER"), "high": (printed, "SAFE UPPER")},
        "probability_ledger": {"a": (printed, r"P\(PASS\)"), "b": (printed, r"P\(FAIL\)")},
        "phase_state": {"t": (printed, "TEMP"), "p": (printed, "PRESSURE")},
    }

    def ruled(text: Column) -> Column:
        """The rule of the family over its own fields, each read once; those of other families are not looked for."""
        out = F.lit(None).cast("string")
        for name, own in fields.items():
            read = F.struct(*[how(text, label).alias(k) for k, (how, label) in own.items()])
            out = F.when(family == name, let(read, DERIVED[name])).otherwise(out)
        return out

    return let(F.array_join(lines, " | "), ruled)


def _shown(x: Column, places: int) -> Column:
    return F.bround(x, places).cast(f"decimal(38,{places})").cast("string")


def _converted(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for (a, b), (_, factor, offset) in {**CONVERSIONS, ("L", "GAL"): CONVERSIONS["L", "USGAL"]}.items():
        value = x["source"] * F.lit(factor).cast("decimal(11,10)") + F.lit(offset).cast("decimal(2,0)")
        out = F.when((x["unit"] == a) & (x["goal"] == b), F.concat(_shown(value, 2), F.lit(f" {b}"))).otherwise(out)
    return out


def _spilled(x: Column) -> Column:
    full, first, second = x["full"], x["first"], x["second"]
    return F.when((F.least(full, first, second) >= 0) & (first + second - full >= 0), F.concat(_shown(first + second - full, 1), F.lit(" L")))


def _order(x: Column) -> Column:
    offset = x["brake"] - x["stopped"]
    return F.when(offset < 0, "BEFORE THE STOP").when(offset > 0, "AFTER THE STOP").when(offset == 0, "AT THE SAME TIME")


def _outside(x: Column) -> Column:
    t, u, low, high = x["t"], x["u"], x["low"], x["high"]
    far = F.greatest(F.lit(0).cast(DECIMAL), low + u - t, t + u - high)
    return F.when((u >= 0) & (high >= low) & (2 * u <= high - low), F.concat(_shown(far, 1), F.lit(" C")))


def _overlap(x: Column) -> Column:
    width, opening = x["width"], x["opening"]
    return F.when((width >= 0) & (opening >= 0), F.concat(_shown(F.greatest(F.lit(0).cast(DECIMAL), width - opening), 2), F.lit(" M")))


def _state(x: Column) -> Column:
    t = x["t"]
    return F.when((x["p"] == 1) & (t != 0) & (t != 100), F.when(t < 0, "SOLID ICE").when(t < 100, "LIQUID WATER").otherwise("WATER VAPOR"))


#: Family: the value that its fields imply.
DERIVED = {
    "unit_conversion": _converted,
    "temporal_ledger": lambda x: F.concat((x["finish"] - x["start"]).cast("string"), F.lit(" MIN")),
    "capacity_conservation": _spilled,
    "causal_order": _order,
    "geometry_feasibility": _overlap,
    "range_threshold": _outside,
    "probability_ledger": lambda x: F.when(x["a"].between(0, 1) & x["b"].between(0, 1), _shown(x["a"] + x["b"], 2)),
    "phase_state": _state,
}
