import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairlens.functions import answers as A
from pairlens.plans import cases


def test_every_rule_says_what_is_written_down(spark):
    want = {(rule, k): case[-1] for rule, (_, rows) in cases.CASES.items() for k, case in enumerate(rows)}
    got = {(r.rule, r.nth): r.said for r in cases.answer_rules(spark, "").collect()}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {} and len(got) == len(want)


def test_rules_that_reject_raise(spark):
    bad = [
        A.public_score(F.lit("x"), F.array(F.lit("c")), F.lit("Q (a) x (b) y"), F.lit("typod")), A.public_score(F.lit("x"), F.array(F.lit("c")), F.lit(""), F.lit("LingoQA")),
        A.semantic_token(F.lit("maybe"), F.lit("yesno"), F.lit(None).cast("string")), A.semantic_token(F.lit("yes"), F.lit("ab"), F.lit("other")),
        A.detections(F.from_json(F.lit('[{"box":[[0,0]],"text":"a","score":0.9}]'), "array<struct<box:array<array<double>>,text:string,score:double>>"), 0.5),
    ]
    for c in bad:
        with pytest.raises(PySparkException):
            spark.range(1).select(c).collect()
