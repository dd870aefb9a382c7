import numpy as np

import corpus_pipeline
from pairlens.llm import near_dedup, quality_classifier, quality_rules


def test_stages_take_effect_in_order(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(150):
        w = [vocab[j] for j in rng.integers(0, 500, 120)]
        if k % 5 == 0:
            w = [f"{x}###" for x in w]
        rows.append((k, " ".join(w), "en", "s", len(w)))
        labels.append((k, int(k % 5 > 0), 0))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " more", "en", "s", 1), (202, "too short", "en", "s", 1), (203, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] for r in rows}

    good = {r.doc_id for r in quality_classifier.score_documents(docs, lab).collect() if r.predicted}
    part = docs.where(docs.doc_id.isin(*good))
    forest = quality_rules.train(docs, lab)
    good = {r.doc_id for r in quality_rules.judge(part, forest).collect() if r["__verdict"].kept}
    assert {k for k in range(150) if k % 5} <= good and not {k for k in range(150) if k % 5 == 0} & good
    last = {}
    for i in good:
        last[text[i]] = max(i, last.get(text[i], -1))
    left = set(last.values())
    sets = {i: set(near_dedup.shingle_set(text[i]).tolist()) for i in left}
    kept = {i for i in left if not any(j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in left)}
    assert 200 in kept and 1 not in kept and 201 not in kept and 202 not in kept

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "exact dedup", "MinHash near-dedup", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def odd_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(900)]
    rows, labels = [], []
    for k in range(160):
        w = [vocab[j] for j in rng.integers(0, 900, 120)]
        if k % 4 == 0:
            w = [f"{x}###" for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 > 0), 0))
    a, b, c = (" ".join(vocab[j] for j in rng.integers(0, 900, 150)) for _ in range(3))
    rows += [(300, a), (300, a), (300, b), (None, c), (None, c + " more"), (None, None), (301, ""), (302, "long words of text " * 30_000), (None, rows[1][1])]
    rows = [(i, t, "en", "s", 1.5, "clash", i) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, __quality double, __verdict string, __number long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, (a, b, c)


def test_repeated_and_null_ids_clashing_columns_and_empty_tables(spark, tmp_path):
    rows, (a, b, c) = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    base = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, base)
        assert got.schema == docs.schema
        if name == "exact dedup":
            own = got.select("doc_id", "text").collect()
            assert sorted(r.text or "" for r in own) == sorted({t or "" for _, t, *_ in rows})
            for r in own:
                assert r.doc_id == max((i for i, t, *_ in rows if (t or "") == (r.text or "") and i is not None), default=None)
        if name == "MinHash near-dedup":
            texts = [r.text for r in got.collect()]
            # of c and c + " more" one stays, of the copies of a one, b has the id of a and stays
            assert texts.count(a) == 1 and texts.count(b) == 1 and texts.count(c) + texts.count(c + " more") == 1 and texts.count(rows[1][1]) == 1
        assert stage(spark, docs.limit(0), base).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), base).count() == 0


def test_trees_reject_rows_that_reach_them(spark, tmp_path):
    rows, _ = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # rows of the rejected kind that meet the base rules, handed to the second stage alone
    bad = docs.where("doc_id < 160 and doc_id % 4 = 0")
    assert corpus_pipeline.keep_regular(spark, bad, str(tmp_path)).count() == 0
    judged = quality_rules.judge_documents(bad, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert not judged.where("base_failed").count()
