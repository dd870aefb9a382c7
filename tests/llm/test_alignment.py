import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairlens.llm import alignment as op

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_sign():
    """The published byte-level alphabet: printable signs stand for themselves, the others for signs from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


@pytest.fixture(scope="module")
def plain():
    """Text -> (ids of A, their bytes, ids of B, their bytes) by the two libraries on whole texts, or None."""
    a, b, signs = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_sign()
    a.encode_special_tokens = True

    def tokens(text):
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        return (ia, ba, ib, bb) if b"".join(ba) == b"".join(bb) == (" " + text).encode() else None

    return tokens


def brute(tokens):
    """Groups and links by a plain walk over spans."""
    ia, ba, ib, bb = tokens
    ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
    groups, cuts = [], [0, *sorted(set(ea) & set(eb))]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        groups.append([[i for i, e in zip(ids, ends, strict=True) if lo < e <= hi] for ids, ends in ((ia, ea), (ib, eb))])
    links = [(i, j) for i, e, x in zip(ia, ea, ba, strict=True) for j, f, y in zip(ib, eb, bb, strict=True) if max(e - len(x), f - len(y)) < min(e, f)]
    return groups, links


ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "a \n b\n", "\t x \r\n", "<s>a</s> <|endoftext|> x", "a▁b", "<0x41>   c", "é üß  À", "é", "你 好　 世", "नम स्ते x",
    "\U0001f600 \U0001f600‍ x", "it's we'll 've ' s", "x\u0085 y  z   w", "ﬁ ① Ａ", "1234 5678  9", "\x00 \x1c a", "again and again", "again and again", "the  cat", "-- ## $$ %%  ?!",
]


def texts():
    rng = np.random.default_rng(11)
    words = ["the", "thhaeron", "Nicht", "éoionaux", "ción", "###", "a,", "2024", "of.\n", "x\t", "你好", " ", "über"]
    out = [" ".join(words[k] for k in rng.integers(0, len(words), n)) for n in rng.integers(1, 60, 60)]
    alphabet = list(" \n\t 　abé▁'.你\U0001f600")
    out += ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), n)) for n in rng.integers(1, 30, 150)]
    return [*ODD, *out]


def test_equal_to_a_walk_over_whole_texts(spark, plain):
    rows = [(k if k % 40 else None, t, "clash", 1) for k, t in enumerate(texts())]
    rows += [(5, "again and again", "clash", 1), (7, "long text " * 8000, "clash", 1)]
    want, holds = [], Counter()
    for doc, text, *_ in rows:
        tokens = plain(text)
        if tokens and len(text) < 10_000:
            groups, links = brute(tokens)
        elif tokens:  # the walk is quadratic: one repeated part stands for all
            (g, k), n = brute(plain("long text")), 8000
            groups, links = [*g * n, [[220], [tokens[2][-1]]]], [*k * n, (220, tokens[2][-1])]
        else:
            groups, links = [], []
        holds.update(set(links))
        want.append((doc, tokens, groups, links))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    expected = []
    for doc, tokens, groups, links in want:
        printed = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        expected.append((
            doc, len(tokens[0]) if tokens else 0, len(tokens[2]) if tokens else 0, len(groups), len(links),
            sum(holds[x] == best[x[0]] for x in links), sum(holds[x] for x in links), hashlib.sha256(printed.encode()).hexdigest() if tokens else "",
        ))
    assert sum(t is None for _, t, *_ in want) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, times int").repartition(5)
    key = lambda r: tuple(str(x) for x in r)
    for hot in (op.BROADCAST_ROWS, 10):  # all pairs broadcast; few, the others by a shuffle
        got = op.align_documents(df, A, B, hot)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_parts_encode_as_whole_texts_do(plain):
    tok = op.tokenizers_of(A, B)
    assert tok.cuts
    for text in filter(None, texts()):
        data = np.frombuffer((" " + text).encode(), np.uint8)
        bound = [0, *op.cut_places(data).tolist(), len(data)]
        parts = [bytes(data[i:j]).decode() for i, j in zip(bound, bound[1:], strict=False) if j > i]
        ids, n = tok.encode_a([p.encode() for p in parts])
        assert ids.tolist() == tok.first.encode_ordinary(" " + text) and n.sum() == len(ids) and (n > 0).all()
        ids, n = tok.encode_b(parts)
        assert ids.tolist() == tok.second.encode(text) and n.sum() == len(ids)


def test_without_cuts_the_result_is_the_same(plain):
    tok = op.Tokenizers(A, B)
    cut = op.align_texts(texts(), tok)
    tok.cuts = False
    whole = op.align_texts(texts(), tok)
    assert cut[1] == whole[1] and all((cut[0][k] == whole[0][k]).all() for k in cut[0])
    assert all((x == y).all() for x, y in zip(cut[2], whole[2], strict=True))


def test_signs_that_the_pattern_gives_up_on():
    tok = op.tokenizers_of(A, B)
    text = " " * 1_200_000 + "^" * 1_200_000
    counts, digests, _ = op.align_texts([text, "x"], tok)
    assert counts["n_links"][0] >= counts["n_groups"][0] > 0 and digests[0]


def test_empty_table(spark):
    assert op.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
