"""Near duplicates of the pipeline against all pairs."""

import random

import pytest

import corpus_pipeline
from clipwarden.llm import similarity


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def first_of_groups(rows, least=0.8):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                high, low = max(group[a], group[b]), min(group[a], group[b])
                group = [low if g == high else g for g in group]
    return sorted(i for k, (i, _) in enumerate(rows) if group[k] == k)


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((60, 200, 500))))
        rows.append(base)
        rows += [edited(rng, base, n) for n in {60: (1, 2), 200: (2, 4, 8), 500: (5, 10, 30)}[len(base.split())]]
    near = " ".join(f"n{k}" for k in range(100))
    rows += [edited(rng, near, 1) for _ in range(40)]  # one large group
    rows += [None, "", " \n", "one two", "One  TWO", "one three"]
    return list(enumerate(rows))


@pytest.mark.parametrize("part", [512, 7])
def test_groups_are_those_of_all_pairs(spark, texts, part):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    kept = similarity.keep_first(docs, part=part)
    assert sorted(r["doc_id"] for r in kept.collect()) == first_of_groups(texts)


def test_stage_finds_copies_with_edits(spark, texts):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(500))
    rows = [(k, edited(rng, base, 5) if k else base) for k in range(6)]
    docs = spark.createDataFrame([*rows, (10, edited(rng, base, 100))], "doc_id long, text string")
    want = first_of_groups([*rows, (10, docs.filter("doc_id = 10").first()["text"])])
    assert want == [0, 10]
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == want
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_fingerprints_make_candidates(spark):
    """Texts whose fingerprints differ in three bits are compared, also where no band ties them."""
    rows = [(1, 0b0, [1]), (2, 0b111, [2]), (3, -1, [3]), (4, 0b111, [4]), (5, 1 << 40 | (1 << 20) - 1, [5]), (6, 77 << 30, [5])]
    found = similarity.candidates(spark.createDataFrame(rows, "node long, fp long, bands array<long>"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (4, 1), (5, 5), (6, 5)]


def test_pages_of_one_template_part_ways(spark):
    """No two are similar, most share a band with some other: rows of blocks stay within a small multiple of the pages."""
    shared = " ".join(f"s{k}" for k in range(120))
    rows = [(i, shared + " " + " ".join(f"p{i}x{k}" for k in range(70))) for i in range(900)]
    rows.append((900, rows[5][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = docs.selectExpr("doc_id AS node", "text")
    together = texts.selectExpr("node", "0L AS label")  # as if bands had tied them all
    apart = similarity.taken_apart(texts, together, part=32)
    assert sorted(r["node"] for r in apart.collect()) == [5, 900]
    kept = similarity.keep_first(docs, part=32)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(900))


def test_large_group_of_edited_copies(spark):
    """Links of a group larger than a block equal those of all pairs, with stragglers and a second group beside it."""
    rng = random.Random(11)
    base = " ".join(f"w{k}" for k in range(200))
    texts = [edited(rng, base, rng.choice((1, 2, 3))) for _ in range(120)]
    far = edited(rng, base, 30)
    texts += [edited(rng, far, rng.choice((1, 2))) for _ in range(30)] + [edited(rng, base, 14) for _ in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = docs.selectExpr("doc_id AS node", "text")
    found = similarity.links(nodes, nodes.selectExpr("node", "0L AS label"), part=8, asked=2)
    group = {i: i for i, _ in rows}
    for a, b in {tuple(r) for r in found.collect()}:
        high, low = max(group[a], group[b]), min(group[a], group[b])
        group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(set(group.values())) == first_of_groups(rows)
