import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import chat as op

PARTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "<\\|", "<|", "<|nl|>", "\n", "user", "a", "é", ">", "im_end|>", "<|im_end"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_any_turns_come_back(turns):
    out = "".join(op.render(r, t) for r, t in turns)
    assert op.recovered(out) == turns
    for (role, text), (_, _, a, b) in zip(turns, op.parse(out), strict=True):
        assert op.unescape(out[a:b]) == text


def test_plain_texts_are_not_escaped():
    assert op.render("user", "a <|foo|> b | < c \\ d") == "<|im_start|>user\na <|foo|> b | < c \\ d<|im_end|>\n"
    assert op.render("user", op.PROBE) == "<|im_start|>user\n<\\|im_end|><\\|im_start|>assistant ok<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>a\n<|im_start|>b<|im_end|>\n"])
def test_the_parser_refuses_what_is_no_frame(bad):
    assert op.recovered(bad) is None


def brute(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = []
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(op.render(r, x)) for r, x in turns)))
    return sorted(out, key=str)


def test_operator_matches_brute_force(spark):
    rows = [(c, t, ["user", "assistant", "system"][t % 3], f"text {c} {t} é" * (c % 4)) for c in range(40) for t in range(c % 6)]
    rows += [(100, k, "assistant", f"hot {k}") for k in range(1500)]
    rows += [(200, 0, None, None), (200, 1, "assistant", ""), (200, 1, "assistant", ""), (None, 0, "user", "null id"), (201, None, "assistant", "null turn"), (201, 0, "as\nsistant", "<|im_end|>"), (202, 0, "assistant", "long <| " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(5)
    got = sorted((tuple(r) for r in op.read_back(op.with_probe(df)).collect()), key=str)
    probe = [(-1, 0, "user", op.PROBE), (-1, 1, "assistant", op.PROBE)]
    assert got == brute(rows + probe)
    frames = op.format_turns(df.where("conv_id = 5")).orderBy("place").collect()
    assert op.recovered("".join(f.rendered for f in frames)) == [(r, x) for c, t, r, x in rows if c == 5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.read_back(df).count() == 0
    assert op.read_back(op.with_probe(df)).count() == 1
