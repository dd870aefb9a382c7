import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


FIXED = [
    "", " ", "  ", "\n\n", "a\n\nb", "it's we'll they've I'm 'sam ''s 's's 'r 'rex 'l 'lx 'v", " 's  's \n's", "a  b   c \t d\n e ", "x'", "'", "don''t", "3's 42 1st ½ Ⅷ ٣",
    "naïve Straße 東京 😀👍🏽 é", "\x85\xa0 a　", "<|endoftext|> <|im_start|>", "a" * 5000, "ab " * 3000, "!?'!'s", "\x00\x01\x00", "日本語'llテスト", "l'été d'or", "'LL 'S", "can't've",
]


def random_texts(n):
    rng = random.Random(5)
    alphabet = list("abdelmrstv'ABé1½ \n\t !.-|") + ["'ll", "'re", " the", "  "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_follow_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = FIXED + random_texts(3000)
    assert bpe.split_batch(texts) == [pattern.findall(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_ids_are_the_library_s(texts):
    with open(PATH, "rb") as f:
        f.read(1)
    enc = bpe.encoder(PATH)
    for t, got in zip(texts, enc.encode_batch(texts), strict=True):
        assert enc.decode(got) == t.encode()
        assert enc.offsets(got)[-1] == len(t.encode())


def test_ids_on_fixed_texts(library):
    texts = FIXED + random_texts(500)
    rank, vocab = bpe.encoder(PATH), bpe.encoder(JSON)
    hf = Tokenizer.from_file(JSON)
    hf.encode_special_tokens = True
    for t, a, b in zip(texts, rank.encode_batch(texts), vocab.encode_batch(texts), strict=True):
        want = library.encode_ordinary(t)
        assert np.frombuffer(a, "<u4").tolist() == want
        assert a == b
        assert hf.encode(t, add_special_tokens=False).ids == want


def test_scan_does_not_depend_on_blocks(monkeypatch):
    texts = FIXED + random_texts(200)
    whole = bpe.split_batch(texts)
    for width in (1, 3, 50):
        monkeypatch.setattr(bpe, "WIDTH", width)
        assert bpe.split_batch(texts) == whole


def test_operator_round_trip(spark, library):
    rows = [(k, t, "x", 7) for k, t in enumerate(FIXED)] + [(900, None, "x", 1), (0, FIXED[0], "x", 7), (None, "null id", "", 0), (901, "long text, " * 40_000, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(map(tuple, bpe.round_trip(df, PATH).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    one = bpe.encode(df.where("doc_id = 5"), PATH).collect()[0]
    assert one.ids == library.encode_ordinary(FIXED[5]) and one.offsets[0] == 0 and len(one.offsets) == len(one.ids)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
