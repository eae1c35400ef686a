"""Corpus operators against brute force on small fixtures."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from clipwarden.llm import curriculum, decontaminate, encoding, licenses, line_dedup, maxscore, quality, repeats, simhash, token_files, tool_calls
from clipwarden.llm.graph import components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, n_words int, rk string"
BASE = " ".join(f"w{i % 37}x{i // 5}" for i in range(60))
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " tail one"), (4, "intro " + BASE), (5, ""), (6, None), (7, "a b"), (8, "Été ÉTÉ! one\ttwo\n three"),
    (9, "same " * 40), (10, "x" * 3000 + " " + BASE), (None, BASE), (None, None), (2, BASE), (11, "  lead\n\ndouble  blank "),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("s0", "s1", None)[k % 3], k, "z") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return WORD.findall(t or "")


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_contamination(spark, docs):
    items = spark.createDataFrame(
        [(1, " ".join(BASE.split()[5:25])), (2, "A, b"), (3, None), (4, ""), (None, "one two"), (1, BASE)], "item_id long, text string"
    )
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for i, t in rows(items, "item_id", "text"):
        w = cut.findall(lowered(t))
        n = min(13, len(w))
        windows |= {(tuple(w[k : k + n]), "" if i is None else str(i)) for k in range(len(w) - n + 1) if n}
    want = []
    for i, t in TEXTS:
        w, hit, names = cut.findall(lowered(t)), set(), set()
        for win, name in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = rows(decontaminate.contamination_report(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr)
    assert decontaminate.contamination_report(docs.limit(0), items).count() == 0
    assert decontaminate.contamination_report(docs, items.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("n", [3, 13, 30])
def test_repeats(docs, n):
    first = {}
    for i, t in TEXTS:
        w, d = words(t), 2**63 if i is None else i
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, d), d)
    want = []
    for i, t in TEXTS:
        w, d, gone = words(t), 2**63 if i is None else i, set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < d:
                gone |= set(range(k, k + n))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = repeats.drop_repeats(docs, n).select(
        "doc_id", "n_words", repeats.removed_words(F.col("removed")).alias("n"), F.array_join("kept_words", " ").alias("kept")
    )
    assert rows(got, "doc_id", "n_words", "n", "kept") == sorted(want, key=repr)
    assert repeats.drop_repeats(docs.limit(0), n).count() == 0


def fingerprint(t):
    w = words(lowered(t))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    fps = [fingerprint(t) for _, t in TEXTS]
    ids = [2**63 if i is None else i for i, _ in TEXTS]
    label = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    low = [min(ids[b] for b in range(len(fps)) if label[b] == label[a]) for a in range(len(fps))]
    want = [(i, f"{f:016x}", None if c == 2**63 else c) for (i, _), f, c in zip(TEXTS, fps, low)]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")
    assert rows(got, "doc_id", "f", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs).count() == len(set(low)) and simhash.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("block", [4, 1024])
def test_links_join_what_all_pairs_join(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(25):
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"] % 2**64: r["label"] % 2**64 for r in components(simhash.links(nodes, 3, block), "a", "b").collect()}
    groups = lambda name: {frozenset(g for g in fps if name(g) == name(f)) for f in fps}
    assert groups(root) == groups(lambda f: found.get(f, f))


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_files(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    key = {(r["doc_id"], r["text"]): r["k"] for r in docs.withColumn("k", F.xxhash64(F.coalesce("doc_id", F.lit(2**63 - 1)), F.coalesce("text", F.lit("")))).collect()}
    order = sorted(TEXTS, key=lambda r: (2**63 - 1 if r[0] is None else r[0], key[r]))
    start, want = 0, []
    for i, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_file_digest(docs, tokenizer(), segment=50, block=16)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files.token_file_digest(docs.limit(0), tokenizer()).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for high, n in ((1, 1), (2, 5), (50_257, 3000), (2**32, 700)):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[:: 97] = 2**32 - 1
        for block in (1, 128, 1024):
            data = token_files.pack(ids, block)
            assert (token_files.unpack(data) == ids).all()
            assert (token_files.unpack(data, n // 3, 7) == ids[n // 3 : n // 3 + 7]).all()


def test_pieces_encode_like_whole_texts():
    e = encoding.Encoder(tokenizer())
    odd = [t or "" for _, t in TEXTS] + ["a <|endoftext|> b", "it's we'll", "a\tb c", "\nx", "x\n", "a\n\nb", "é'é 1,2", "你好 世界, a1", "a , b ,c"]
    assert e.encode(odd) == e.whole(odd)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=8).round(1).tolist()) for i in range(260)] + [(300, None), (350, [float("nan")] * 8), (400, [None] * 8), (None, [1.0] * 8)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in data[:260]}
    want = []
    for q in range(0, 260, 50):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    for shard in (7, 4096):
        got = maxscore.top_k(e, F.col("vec_id") % 50 == 0, shard=shard, queries_at_once=2)
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert maxscore.top_k(e.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix(spark):
    data = [(i, "w " * (i % 23 + 1), f"s{i % 4}" if i % 7 else None, 0, "") for i in range(400)] + [(900, None, "s0", 0, ""), (901, "", "s1", 0, "")]
    d = spark.createDataFrame(data, SCHEMA)
    got = curriculum.mix(d, bucket_rows=20)
    rows_ = got.collect()
    assert len(rows_) == len(data) and all(r["size"] == len(words(t)) for r in rows_ for i, t, *_ in data if i == r["doc_id"])
    per = {}
    for r in rows_:
        per.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
    sizes = [(sum(r["size"] for r in per[s]), (3, 1, 2)[k % 3]) for k, s in enumerate(["s0", "s1", "s2", "s3", None])]
    for s, goal in zip(["s0", "s1", "s2", "s3", None], curriculum.targets(sizes)):
        assert abs(per[s][0]["target"] - goal) < 1e-6 and abs(sum(r["taken"] for r in per[s]) - goal) <= 23
    assert rows(got, "doc_id", "taken") == rows(curriculum.mix(d.repartition(7), bucket_rows=20), "doc_id", "taken")
    assert curriculum.mixed_documents(d).count() == sum(r["copies"] for r in rows_)
    assert curriculum.mix(d.limit(0)).count() == 0


def test_due_time_inverts_the_integral(spark):
    knots = [[0.0, 2.0], [0.5, 0.0], [1.0, 6.0]]
    area = lambda t: 2 * t - 2 * t * t if t <= 0.5 else 0.5 + 6 * (t - 0.5) ** 2
    df = spark.createDataFrame([(t / 20, area(t / 20) / 2.0, knots) for t in range(21)], "t double, s double, k array<array<double>>")
    for r in df.select("t", curriculum.due_time(F.col("s"), F.col("k")).alias("x")).collect():
        assert abs(r["t"] - r["x"]) < 1e-6


def test_quality_held_out(spark):
    rng = np.random.default_rng(0)
    data, labels = [], []
    for i in range(900):
        text = " ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(20, 60)))
        grade = i % 3
        text = text + " vile" if grade == 0 else " ".join(w + "##" for w in text.split()) if grade == 1 else text
        data.append((i, text, "s", 0, ""))
        if i < 600:
            labels.append((i, int(grade == 2), int(grade == 0)))
    d = spark.createDataFrame([*data, (None, None, None, None, None)], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(d, lab)
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r["keep"] for r in quality.grade_documents(d, model).collect()}
    assert len(got) == 901
    assert np.mean([got[i] == (i % 3 == 2) for i in range(600, 900)]) > 0.95
    assert quality.keep_good(d, model).columns == d.columns
    assert quality.grade_documents(d, quality.fit_on(d, lab.limit(0))).count() == 901


def test_licences(spark):
    files = spark.createDataFrame(
        [
            (1, "/a/LICENSE", "x\nReleased under the MIT License."), (2, "/a/b/c.txt", "none"), (3, "/a/b/COPYING", "Licensed under CC BY-NC 4.0."),
            (4, "/z.txt", "This work is licensed under the GNU General Public License, version 3."), (5, None, None), (6, "/q/r.txt", ""),
            (7, "/a/d/e/f.txt", "word " * 500),
        ],
        "doc_id long, path string, text string",
    )
    got = {r["doc_id"]: (r["licence"], r["via"], r["taken_from"]) for r in licenses.license_scan(files).collect()}
    assert got == {
        1: ("MIT", "statement", None), 2: ("CC-BY-NC-4.0", "directory", "/a/b"), 3: ("CC-BY-NC-4.0", "statement", None),
        4: ("GPL-3.0", "statement", None), 5: (None, None, None), 6: (None, None, None), 7: ("MIT", "directory", "/a"),
    }
    assert licenses.license_scan(files.limit(0)).count() == 0


def test_site_lines(spark):
    pages = spark.createDataFrame(
        [(i, f"http://www.h.org/{i}", f"<p>menu<p>own {i}<br>x{i % 2}") for i in range(4)] + [(9, None, None), (10, "http://k.org", "")],
        "page_id long, url string, html string",
    )
    got = line_dedup.drop_site_lines(pages, line_dedup.url_host(F.col("url")), line_dedup.html_lines(F.col("html")))
    assert {r["page_id"]: list(r["kept"]) for r in got.collect()} == {**{i: [f"own {i}"] for i in range(4)}, 9: [], 10: []}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "t", '{"b": 1, "a": "x"}', []), (1, "c", 1, "t", '{"a": 5}', ["b"]), (1, "b", 2, "t", "broken", ["a", "zz"]),
            (1, "p", 3, "u", "{}", ["q"]), (1, "q", 4, "u", "{}", ["p"]), (None, "n", 0, "t", "{}", None), (2, "a", 0, None, None, None),
        ],
        "conv long, call string, turn int, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "a", 1, "r1"), (1, "a", 5, "r2"), (3, "x", 0, "lost")], "conv long, call string, turn int, content string")
    got = {(r["conv"], r["call"]): r for r in tool_calls.format_calls(calls, results, {"t": {"a": ("string", True)}}).collect()}
    assert [got[1, c]["position"] for c in "abcpq"] == [0, 1, 2, 3, 4] and [got[1, c]["level"] for c in "abcpq"] == [0, 1, 2, None, None]
    assert got[1, "a"]["json"] == '{"arguments":{"a":"x","b":1},"id":"a","name":"t","result":"r1"}' and got[1, "a"]["n_results"] == 2
    assert list(got[1, "c"]["problems"]) == ["a: not string"] and list(got[1, "b"]["problems"]) == ["arguments: no JSON"]
    assert list(got[2, "a"]["problems"]) == ["unknown tool"]
    assert list(got[3, "x"]["problems"]) == ["no call"] and got[3, "x"]["n_calls"] == 0 and len(got) == 7


def test_the_classifier_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the weights; they are those of a fit on the same sample."""
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} x{i % 2}", "s", 0, "") for i in range(90)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    here, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: (here.append(1), fit(*a, **k))[1])
    model = quality.fit_on(docs, labels)
    assert not here
    assert len(model.keys) == 7 and (np.diff(model.keys) > 0).all()
    assert model.bands.shape == (quality._BAND_KEYS, quality.BANDS) and model.cuts[0] < model.cuts[1]
