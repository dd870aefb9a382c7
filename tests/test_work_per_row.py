import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.functions import record as R
from pairlens.functions import text as T
from pairlens.functions import text_exact as X
from pairlens.plans import scoring, texts

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_are_read_once_and_dealt_over_all_cores(spark):
    q = scoring.question_scores(spark, SF)
    assert plan_of(q).count("[a-d]") <= 6  # both patterns of the options, and the letter's
    assert scoring.parts(spark, SF, "say", 6).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_answer_is_lowered_once(spark):
    q = spark.createDataFrame([("The two 1,000 cats",), (None,)], "a string").select(T.normalize_answer(F.col("a")).alias("n"))
    assert plan_of(q).count("[^a-z0-9']+") == 1
    assert [r.n for r in q.collect()] == ["2 1000 cats", "none"]


def test_records_are_dealt_and_only_fields_of_their_family_are_read(spark):
    assert texts.records(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # lines that would name every family's fields: only those of the own family count
    lines = F.array(F.lit("START 10:05"), F.lit("FINISH 10:45"), F.lit("P(PASS) 0.25"), F.lit("P(FAIL) 0.5"))
    d = spark.createDataFrame([("temporal_ledger", "40 MIN"), ("probability_ledger", "0.75"), ("causal_order", None), (None, None)], "f string, want string")
    q = d.select("want", R.derived_value(F.col("f"), lines).alias("got"))
    assert all(r.got == r.want for r in q.collect())
    assert plan_of(q).count("START") <= 3  # the label of the field, not once for each use of its value


def test_pages_are_not_python_strings_all_at_once():
    page = "<p>a &amp; b</p>" * 2_000
    texts = pa.array([page, None] * 1_000)
    tracemalloc.start()
    got = X.plain_slices(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == "a & b " * 1_999 + "a & b" and got[1].as_py() is None and len(got) == 2_000
    assert peak < 200 * len(page)  # 1,000 pages hold five times that
    assert X.plain_slices(texts[:0]).to_pylist() == []
