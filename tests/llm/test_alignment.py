"""Alignment of two tokenizers against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from clipwarden.llm import alignment as A
from clipwarden.llm.encoding import Encoder, PieceEncoder

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
files = pytest.importorskip("public_tokenizers")
BPE, PIECE = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")
ODD = ["a", "Bc", "é", "中文", "1", "23", " ", "  ", "\n", "\t", "\r\n", ".", "'s", " the", " of", "#", "<|endoftext|>", "🙂", "it's", "▁", "<s>", "<0x41>", "́", "\xa0"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def brute(rows):
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    names = {v: k for k, v in t.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        ends = []
        table = A._byte_alphabet()
        size_a = [bytes(table[c] for c in names[i]) for i in a]
        size_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(size_a) != raw or b"".join(size_b) != raw:
            found.append((doc, [], [], 0, [], ""))
            continue
        for sizes in (size_a, size_b):
            ends.append(np.cumsum([len(s) for s in sizes]).tolist())
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in common:
            part = [[str(i) for i, e in zip(ids, es) if last < e <= c] for ids, es in ((a, ends[0]), (b, ends[1]))]
            groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
            last = c
        spans = [list(zip(ids, [0, *es[:-1]], es)) for ids, es in ((a, ends[0]), (b, ends[1]))]
        links = [(x, y) for x, s, e in spans[0] for y, p, q in spans[1] if s < q and p < e]
        counts.update(set(links))
        found.append((doc, a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(
        ((d, len(a), len(b), g, len(k), sum(counts[p] == best[p[0]] for p in k), sum(counts[p] for p in k), h) for d, a, b, g, k, h in found), key=repr
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "the of Straße naïve tokens alignment 2024 don't überall 東京 café x=y".split()
    out = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(60)]
    out += [(100 + k, t) for k, t in enumerate(odd_texts(80))]
    out += [(900, None), (901, ""), (902, " "), (None, "the of"), (903, "no <|endoftext|> here </s> <unk>"), (904, "word " * 3000)]
    return [*out, out[0], out[0]]


@pytest.mark.parametrize("hot", [A.HOT_PAIRS, 20, 1])
def test_against_loops(spark, rows, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = A.alignment(docs.selectExpr("*", "1 AS id", "'x' AS pairs", "2 AS row"), BPE, PIECE, hot_pairs=hot)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id long, text string"), BPE, PIECE).count() == 0


def test_galloping_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n, m in ((1, 5), (50, 50), (1000, 30), (30, 1000)):
        ends, asked = np.sort(rng.integers(0, 500, n)), rng.integers(0, 500, m)
        for start in (np.zeros(m, int), np.full(m, n), rng.integers(0, n, m)):
            assert (A.gallop(asked, ends, start) == np.searchsorted(ends, asked)).all()


def test_encoders_equal_the_libraries(monkeypatch):
    texts = odd_texts(3000, 8)
    from clipwarden.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBERED", 50)
    for plain in (False, True):
        e = Encoder(BPE, plain)
        assert e.encode(texts) == e.whole(texts)
        assert e.encode_after_blank(texts) == e.whole([" " + t for t in texts])
    p = PieceEncoder(PIECE)
    assert p.encode(texts) == p.whole(texts)
    assert p.encode(texts) == p.whole(texts)
