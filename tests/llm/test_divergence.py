"""Source divergence against plain loops, and the perfect hashes against their keys."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clipwarden.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = term.findall(lower(text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for at, s in counts if at == lang]

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in own}
        q = share(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in own if x != s]
            more = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                listed = found if part == "pair" else found[:top]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(listed)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("Re", "no", "é", "中", "tI") for b in "abcdefghijkl"] + ["x1y", "don't", "A_b"]
    out = []
    for k in range(400):
        # one source holds half of all rows
        source = "hot" if k % 2 else rng.choice(["s1", "s2", "s3", None, ""])
        few = words[k % 7 :: 3] if source == "s1" else words
        out.append((k, " ".join(rng.choices(few, k=rng.randrange(0, 25))), rng.choice(["en", "fr", None]), source))
    out += [(1000, None, "en", "silent"), (1001, "", "xx", "s1"), (1002, "12 34", "xx", None), (1003, None, None, None)]
    return [*out, out[3], out[3]]


@pytest.mark.parametrize("shard_keys, size, block, sources", [(1 << 15, 1 << 25, 4096, 64), (5, 1 << 25, 7, 2), (5, 0, 9, 1)])
def test_against_loops(spark, rows, shard_keys, size, block, sources):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = D.divergence(docs, least=12, top=6, shard_keys=shard_keys, broadcast_bytes=size, block=block, sources=sources)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 6)


def test_full_workers_hand_on(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for size in (1 << 25, 0):
        got = D.divergence(docs, least=12, top=6, shard_keys=9, broadcast_bytes=size)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 6)


def test_pairs_do_not_depend_on_the_order_of_a_block():
    row = lambda s, p: {"lang": "en", "source": s, "own": 0, "none": 1, "width": 1, "a": 0, "b": 0, "listed": [{"at": 0, "p": p}]}
    rows = [row("s", 7), row("r", 12), row("t", 30)]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        got = D._pair_sums(pa.Table.from_pylist([rows[i] for i in order])).to_pylist()
        assert sorted((g["x"], g["y"], g["f"]) for g in got) == [("r", "s", 5), ("r", "t", 18), ("s", "t", 23)]


def test_empty_table_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    assert D.divergence(docs.limit(0)).count() == 0
    more = docs.selectExpr("*", "1 AS n", "'x' AS term", "2 AS slot", "3 AS kept")
    assert sorted(tuple(r) for r in D.divergence(more, least=2).collect()) == brute(rows[:40], 2, 50)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal_and_rejects_others(n):
    keys = [f"k{i}é".encode() for i in range(n)]
    seed, moves, slots = D.build_hash(keys)
    assert sorted(slots) == list(range(n))
    stored = [b""] * n
    for key, slot in zip(keys, slots):
        stored[slot] = key
    shard = D.Shard(seed, moves, pa.array(stored, pa.binary()))
    assert (shard.find(keys) == slots).all()
    assert (shard.find([b"other", b"", b"k0"]) == -1).all()
    assert isinstance(slots, np.ndarray)
