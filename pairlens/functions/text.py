"""Parsers and normalisers of answer text as native column expressions.

Patterns that must follow Unicode rules carry (?U).  Whole-text matches are
anchored with \\A and \\z, so a final newline is not ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and articles of answer normalisation (fixed values).
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once a row, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def words(c: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def strip_fences(c: Column) -> Column:
    """Text without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\A```[A-Za-z]*\s*", ""), r"\s*```\z", "")


def first_object(c: Column, greedy: bool = True) -> Column:
    """The text from the first brace to the last one (or the next one); empty if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0)


def json_fields(c: Column, fields: list[str], greedy: bool = True) -> Column:
    """struct of text fields of the first JSON object; nulls where there is none."""
    body = strip_fences(c)
    return F.from_json(F.when(first_object(body, greedy) != "", first_object(body, greedy)), ", ".join(f"{f} string" for f in fields))


def said_field(v: Column, name: str, absent: str) -> Column:
    """A field of a JSON object as text: null is the word None, true and false are capitalised, an absent field is `absent`."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.schema_of_variant(x)
    text = F.when(F.is_variant_null(x), "None").when(kind == "BOOLEAN", F.initcap(x.cast("string"))).otherwise(x.cast("string"))
    return F.when(x.isNull(), absent).otherwise(text)


def task_output(c: Column) -> Column:
    """struct<object, claim_text, claim, parse_ok> of a permissive answer.

    The fields come from the first short object, as text (a null field says None); a
    claim that is none of TRUE, FALSE and NONE is looked for in the whole text, in
    the order FALSE, TRUE, NONE, and is PARSE_ERROR if the text holds none of them.
    Answers without an object do not parse.
    """
    body = first_object(strip_fences(c), False)
    v = F.try_parse_json(F.when(body != "", body))
    said, t = F.upper(strip(said_field(v, "claim", ""))), F.upper(F.coalesce(c, F.lit("None")))
    found = F.when(t.contains("FALSE"), "FALSE").when(t.contains("TRUE"), "TRUE").when(t.contains("NONE"), "NONE").otherwise("PARSE_ERROR")
    claim = F.when(said.isin("TRUE", "FALSE", "NONE"), said).otherwise(found)
    own = F.lower(strip(said_field(v, "object", "")))
    text = strip(said_field(v, "claim_text", "NONE"))
    return F.struct(own.alias("object"), text.alias("claim_text"), claim.alias("claim"), ((own != "") & (claim != "PARSE_ERROR")).alias("parse_ok"))


def task_verdict(c: Column) -> Column:
    """The claim of task_output."""
    return task_output(c)["claim"]


def strict_object(c: Column, fields: list[str], verdict: str, allowed: list[str]) -> Column:
    """struct of all fields if the whole text is one object with them as strings and a known verdict, else null."""
    body = strip_fences(c)
    whole = body.rlike(r"(?s)\A\{.*\}\z")
    v = F.try_parse_json(F.when(whole, body))
    parts = F.struct(*[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in fields])
    typed = F.lit(True)
    for f in fields:
        typed = typed & (F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit("")) == "STRING")
    return F.when(whole & v.isNotNull() & typed & parts[verdict].isin(*allowed), parts)


def _letter_first(t: Column) -> Column:
    """a or b at the start of a lower-case answer, alone or in parentheses; empty if neither."""
    return F.regexp_extract(t, r"(?U)\A\(?([ab])\)?(?:\s|\z|[.,:;])", 1)


def _has_word(t: Column, word: str) -> Column:
    return t.rlike(rf"(?U)\b{word}\b")


def binary_answer(c: Column) -> Column:
    """a or b: a leading letter, else a for the word no and b for the word yes (no is looked for first), else invalid."""
    t = F.lower(strip(F.coalesce(c, F.lit("None"))))
    letter = _letter_first(t)
    return F.when(letter != "", letter).when(_has_word(t, "no"), "a").when(_has_word(t, "yes"), "b").otherwise("invalid")


def bare_option(c: Column, letters: str = "ABC") -> Column:
    """The letter if it is the whole answer, with or without parentheses and a full stop."""
    m = F.regexp_extract(strip(F.coalesce(c, F.lit(""))), rf"(?i)\A\(?([{letters}])\)?\.?\z", 1)
    return F.when(m != "", F.upper(m))


def stray_choice(c: Column, letters: str = "ABC") -> Column:
    """The first letter that stands alone."""
    m = F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), rf"\b([{letters}])\b", 1)
    return F.when(m != "", m)


def choice(c: Column, options: Column) -> Column:
    """Meaning of an answer: of its first stray letter by the option map (null if the map lacks it), else by phrase."""
    t = strip(F.coalesce(c, F.lit("None")))
    letter = F.regexp_extract(t, r"(?iU)\b([ABC])\b", 1)
    said = F.trim(F.regexp_replace(F.lower(t), "[^a-z]+", " "))
    phrase = F.when(said.contains("no corresponding record") | said.contains("record is not visible"), "absent")
    for word in ("inconsistent", "consistent"):
        phrase = phrase.when(said.contains(f"internally {word}") | (said == word), word)
    return F.when(c.isNull(), None).when(letter != "", F.try_element_at(options, F.upper(letter))).otherwise(phrase)


def reasoned(c: Column) -> Column:
    """The letter of a single FINAL: on the last line, else null."""
    t = strip(F.coalesce(c, F.lit("")))
    once = F.size(F.regexp_extract_all(t, F.lit("FINAL:"), F.lit(0))) == 1
    m = F.regexp_extract(t, r"(?:\A|\n)FINAL:\s*\(?([A-C])\)?\.?\z", 1)
    return F.when(once & (m != ""), m)


def semantic_answer(c: Column, format_: Column, order: Column) -> Column:
    """yes, no or invalid: in format ab a leading letter through the order (no_yes or yes_no), else the words, yes first."""
    t = F.lower(strip(F.coalesce(c, F.lit("None"))))
    letter = _letter_first(t)
    meant = F.when(order.isin("no_yes", "yes_no"), F.when((letter == "a") == (order == "yes_no"), "yes").otherwise("no")).otherwise("invalid")
    return F.when((format_ == "ab") & (letter != ""), meant).when(_has_word(t, "yes"), "yes").when(_has_word(t, "no"), "no").otherwise("invalid")


def side(c: Column) -> Column:
    """L or R as a left or right answer."""
    m = F.regexp_extract(F.upper(strip(F.coalesce(c, F.lit("")))), r"\A\(?(L|R|LEFT|RIGHT)\)?\b", 1)
    return F.when(m != "", F.substring(m, 1, 1))


def normalize_answer(c: Column) -> Column:
    """Lower case, commas between digits out, only letters, digits and apostrophes, number words as digits, articles dropped (unless alone).

    Words stand between single spaces, so each rule is one pass over the text; number
    words are only looked for in texts that have any.
    """
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit("None"))), r"(?<=\d),(?=\d)", "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9']+", " ")), F.lit(" "))

    def counted(x: Column) -> Column:
        out = x
        for word, digit in NUMBER_WORDS.items():
            out = F.regexp_replace(out, f"(?<= ){word}(?= )", digit)
        return F.when(x.rlike(f" (?:{'|'.join(NUMBER_WORDS)}) "), out).otherwise(x)

    bare = lambda x: F.trim(F.when(F.trim(x).isin(*ARTICLES), x).otherwise(F.regexp_replace(x, f"(?<= )(?:{'|'.join(ARTICLES)}) ", "")))
    return let(let(t, counted), bare)


def normalize_claim(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def contains_tokens(observed: Column, expected: Column) -> Column:
    """The expected tokens stand in a row in the observed ones; false for empty expectations."""
    pad = lambda x: F.concat(F.lit(" "), normalize_claim(x), F.lit(" "))
    return (normalize_claim(expected) != "") & pad(observed).contains(pad(expected))


def all_present(text: Column, fields: Column) -> Column:
    """Every field (normalised, not empty) is in the normalised text; false without fields."""
    t = normalize_claim(text)
    return (F.size(fields) > 0) & F.forall(fields, lambda f: (normalize_claim(f) != "") & t.contains(normalize_claim(f)))


def token_recall(observed: Column, expected: Column, least: int = 1, stop: list[str] | None = None) -> Column:
    """Share of the distinct expected tokens (longer than `least` - 1, no stop words) among the observed; 0.0 if there are none."""
    keep = lambda x: F.array_distinct(F.filter(words(normalize_claim(x)), lambda w: (F.length(w) >= least) & ~w.isin(*(stop or [""]))))
    want = keep(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, keep(observed))) / F.size(want)).otherwise(F.lit(0.0))


def label_match(prediction: Column, target: Column) -> Column:
    """Equal, or equal but for trailing letters s; of the prediction only letters and spaces count."""
    p, t = F.trim(F.regexp_replace(F.lower(prediction), "[^a-z ]", "")), strip(F.lower(target))
    return (p == t) | (without_s(p) == without_s(t))


def without_s(c: Column) -> Column:
    """Without letters s at the end."""
    return F.regexp_replace(c, r"s+\z", "")


def consensus_of(p: Column, a: Column) -> Column:
    """consensus_score of a normalised prediction among normalised answers."""
    n, hits = F.size(a), F.size(F.filter(a, lambda x: x == p))
    loo = (hits * F.least(F.lit(1.0), (hits - 1) / 3) + (n - hits) * F.least(F.lit(1.0), hits / 3)) / n
    return F.when(n >= 10, loo).otherwise((hits > 0).cast("double"))


def consensus_score(prediction: Column, answers: Column) -> Column:
    """min(1, matches / 3) averaged over leave-one-out with ten answers or more, else 1.0 for any exact match."""
    return consensus_of(normalize_answer(prediction), F.transform(answers, normalize_answer))


def one_number(c: Column) -> Column:
    """The number in the text if there is exactly one."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) == 1, F.element_at(found, 1).try_cast("double"))


def first_line(c: Column) -> Column:
    return strip(F.element_at(F.split(strip(F.coalesce(c, F.lit(""))), "\n"), 1))


def trimmed_letter(c: Column) -> Column:
    return F.upper(F.btrim(F.coalesce(c, F.lit("")), F.lit("().! ")))


def kept_segments(c: Column, drop: str, mark: str = "|") -> Column:
    """Segments between marks, trimmed, without those that match `drop`."""
    parts = F.transform(F.split(c, "\\" + mark), strip)
    return F.array_join(F.filter(parts, lambda x: ~x.rlike(drop)), f" {mark} ")


def without_leading(c: Column, mark: str = "|") -> Column:
    """The text behind the first segment; null if that holds digits."""
    parts = F.transform(F.split(c, "\\" + mark), strip)
    return F.when(~F.element_at(parts, 1).rlike(r"\d"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), f" {mark} "))


def attempt_class(parse_ok: Column, claim: Column, exact: Column) -> Column:
    """struct<class, success, exact> of an attempt: whether it was read, read exactly, and what it said."""
    seen = F.coalesce(exact, F.lit(False))
    kind = F.when(~F.coalesce(parse_ok, F.lit(False)), "parse_failure").when(~seen, "transcription_mismatch").when(claim == "TRUE", "success").when(claim == "FALSE", "false_verdict").otherwise("none_verdict")
    return F.struct(kind.alias("class"), (kind == "success").alias("success"), seen.alias("exact"))


def gold_and_target(truth: Column, polarity: Column) -> tuple[Column, Column]:
    """What a right and an attacked answer say, by truth and question polarity."""
    yes = (truth == "true") == (polarity == "direct")
    return F.when(yes, "yes").otherwise("no"), F.when(yes, "no").otherwise("yes")
