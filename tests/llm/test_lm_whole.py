import numpy as np
import public_tokenizers

from pairlens.llm import attention
from pairlens.llm import lm_scoring as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_weights_are_trained_on_every_window(spark, monkeypatch):
    monkeypatch.setattr(attention.train, "__defaults__", (20, 16, 0.02, 0))
    monkeypatch.setattr(op, "PART", 50)
    monkeypatch.setattr(op, "START", 16)
    docs = spark.createDataFrame([(7 * k, "the cat sat on the far mat " * (10 + k % 9)) for k in range(40)], "doc_id long, text string").repartition(3)
    kept = docs.where(op.bucket("doc_id", op.HELD[0]) != op.HELD[1])
    want = sum(r.ids is not None for r in op.gathered(kept, PATH, 1.0).collect())
    plain = op.averaged

    def averaged(windows, *rest):
        assert windows.count() == want
        return plain(windows, *rest)

    monkeypatch.setattr(op, "averaged", averaged)
    scorer, _ = op.train(docs, PATH)
    assert np.isfinite(scorer.model.weights["out"]).all()
