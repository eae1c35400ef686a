"""The whole pipeline against plain loops on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipwarden.llm.text import row_key

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, lang string"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    items = [(i, say(30)) for i in range(6)] + [(6, None), (7, "Two Words")]
    docs, labels = [], []
    for i in range(300):
        text, grade = say(rng.integers(20, 60)), i % 3
        if grade == 0:
            text += " vile"
        elif grade == 1:
            text = " ".join(w + "##" for w in text.split())
        elif i % 5 == 0:
            text += " " + " ".join(items[i % 6][1].split()[4 : 4 + 9 + i % 8])  # spans around the window of 13
        elif i % 7 == 0 and len(docs) > 30:
            text = docs[i - 30][1] + ("" if i % 2 else " extra")  # copies, exact and near
        docs.append((i, text, ("b", "a", "c", None)[i % 11 % 4], "en"))
        labels.append((i, int(grade == 2), int(grade == 0)))
    docs += [(500, None, "a", None), (501, "", None, "en"), (docs[2][0], docs[2][1], docs[2][2], "en")]
    folder = tmp_path_factory.mktemp("corpus")
    for name, rows, schema in (
        ("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), docs, items


def shingles(t):
    w = BLANK_WORD.findall(lowered(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def first_of_groups(docs, least=0.8):
    """Smallest id of each group of all pairs of this similarity; equal rows count once."""
    docs = sorted(set(docs))
    sets, group = [shingles(d[1]) for d in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                high, low = max(group[a], group[b]), min(group[a], group[b])
                group = [low if g == high else g for g in group]
    return [d for k, d in enumerate(docs) if group[k] == k]


def contaminated(text, windows):
    w = LETTER_WORD.findall(lowered(text))
    hit = {k + j for k in range(len(w)) for n in {len(x) for x in windows} if tuple(w[k : k + n]) in windows for j in range(n)}
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def training_order(docs, order):
    """(position, document) of each copy the mix takes, from its source's target and the words before it."""
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {d: len(BLANK_WORD.findall(d[1] or "")) for d in docs}
    total = {s: sum(size[d] for d in docs if d[2] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else share[s]
        left, free = left - sum(target[s] for s in over), free - over if over else set()
    out = []
    for k, s in enumerate(names):
        # the weight falls from 1.5 to 0.5 of its mean, or rises; its integral is (1 + c) x - c x^2
        c, before = (0.5, -0.5)[k % 2], 0
        for d in sorted((d for d in docs if d[2] == s), key=order):
            for copy in range(2):
                start = copy * total[s] + before
                if size[d] > 0 and start + size[d] / 2 <= target[s]:
                    out.append((((1 + c) - math.sqrt((1 + c) ** 2 - 4 * c * start / target[s])) / (2 * c), d))
            before += size[d]
    return [d for _, d in sorted(out, key=lambda x: (x[0], x[1][0]))]


def test_pipeline_against_loops(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    folder, docs, items = tables
    encode = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")).encode
    source = spark.read.parquet(f"{folder}/documents.parquet")
    good = [tuple(r) for r in corpus_pipeline.good_documents(spark, source, folder).collect()]
    made_good = [d for d in docs if d[0] % 3 == 2 and d[0] < 500]
    # the labelled classes are told apart by construction
    assert sorted(d[0] for d in good if d[0] < 500) == sorted(d[0] for d in made_good)
    kept = first_of_groups(good)
    windows = set()
    for _, t in items:
        w = LETTER_WORD.findall(lowered(t))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    clean = [d for d in kept if not contaminated(d[1], windows)]
    assert len(set(good)) > len(kept) > len(clean) > 40
    keyed = spark.createDataFrame(clean, SCHEMA).withColumn("rk", row_key("doc_id", "text"))
    keys = {r["doc_id"]: (r["o"], r["doc_id"]) for r in keyed.select("doc_id", F.xxhash64(F.lit(0), "doc_id", "rk").alias("o")).collect()}
    taken = training_order(clean, lambda d: keys[d[0]])
    assert set(Counter(taken).values()) == {1, 2} and len(set(taken)) < len(clean)
    want, start = [], 0
    for d in taken:
        ids = [*encode(d[1] or "", add_special_tokens=False).ids, 2]
        want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.orderBy("start").collect()] == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"id": F.lit(1), "_s": F.lit("x"), "words": F.lit(None).cast("string")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
