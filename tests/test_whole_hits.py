import random

from pairlens.plans import texts


def test_whole_texts_count_and_openings_do_not(spark):
    passage = "The red cat, sat on the old mat and then it ran far away"
    documents = [(1, "So: the RED cat sat on the old mat, and then it ran far away!"), (2, "the red cat sat on a roof"), (3, "sat on the old mat and then it ran far away"), (4, "he said hello there twice"), (5, None), (6, ""), (7, "the red cat sat on the old mat and then it ran home")]
    benchmark = [(1, passage), (2, "Hello there"), (3, "..."), (4, None), (5, "lo there")]
    d = spark.createDataFrame(documents, "doc_id long, text string")
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    for most in (10**6, 0):  # an automaton; a join by tokens
        assert sorted(map(tuple, texts.whole_hits(d, b, most).collect())) == [(1, 1), (4, 1)]
        assert texts.whole_hits(d, b.limit(0), most).count() == 0


def test_both_ways_equal_a_plain_search(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "cc", "ddd"]) for _ in range(n))
    documents = [(k % 40, text(rng.randint(0, 30))) for k in range(60)]
    benchmark = [(k, text(rng.randint(1, 4))) for k in range(50)]
    want = {}
    for i, t in documents:
        n = sum(f" {x} " in f" {t} " for _, x in benchmark)
        if n:
            want[i] = want.get(i, 0) + n
    d, b = spark.createDataFrame(documents, "doc_id long, text string").repartition(3), spark.createDataFrame(benchmark, "item_id long, text string")
    for most in (10**6, 0):
        assert dict(map(tuple, texts.whole_hits(d, b, most).collect())) == want
