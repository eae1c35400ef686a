"""How sources of one language differ in their use of terms: an exact audit in two passes.

The first pass counts documents per (language, term) and keeps the frequent
terms.  These are dealt to shards by hash, and each shard gets a minimal perfect
hash with its keys stored in slot order.  The second pass looks the terms of the
texts up there, compares each with the stored key, so that a term which was not
kept is never counted, and increments one dense slot array per group.

Shards go to all workers while their total size stays under ``BROADCAST_BYTES``.
Beyond that the counts of terms travel to the shards instead: each task streams
the counts of a shard behind the shard itself.  Both ways give the same rows.

Null texts, languages and sources count as empty ones.  Repeated rows count as
often as they are there.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import stored

LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
SHARD_KEYS = 1 << 15
BROADCAST_BYTES = 32 << 20
HELD = 200_000  # terms or slots a worker holds before it hands them on
BLOCK = 4096  # slots of a block of the pair sums
SOURCES = 64  # sources of a part of the pair sums

# A-Z to a-z, other ASCII letters and all bytes beyond ASCII as they are, the rest to blanks
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
_SHARD_SEED = 0x5EED
_STEP = np.uint64(0x9E3779B97F4A7C15)

SHARDS = "lang string, shards int, shard int, seed bigint, n int, moves binary, keys array<string>"
COUNTS = "lang string, source string, slot bigint, term string, n bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# --- minimal perfect hashes ---------------------------------------------------------------------


def _mixed(h: np.ndarray, move) -> np.ndarray:
    """Hashes under a displacement."""
    x = (h ^ (np.asarray(move).astype(np.uint64) * _STEP)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


def build_hash(keys: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacements and the slot of each of the distinct keys.

    Keys fall into buckets of about four; large buckets first, each takes the
    first displacement that puts its keys on free slots.  Buckets of one key
    take a free slot outright, stored as a negative number.
    """
    n, seed = len(keys), 0
    h = _hashes(keys, seed)
    while len(np.unique(h)) < n:
        seed += 1
        h = _hashes(keys, seed)
    buckets = max(1, n // 4)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    moves, slots, taken = np.zeros(buckets, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        members = order[starts[b] : starts[b] + sizes[b]]
        first = 1
        while True:
            tried = np.arange(first, first + 32)
            at = (_mixed(h[members][None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~taken[at].any(axis=1)
            free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                moves[b], slots[members] = tried[k], at[k]
                taken[at[k]] = True
                break
            first += 32
    alone = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(~taken)
    slots[order[starts[alone]]] = left
    moves[alone] = -left - 1
    return seed, moves, slots


class Shard:
    """A minimal perfect hash with its keys in slot order."""

    def __init__(self, seed: int, moves: np.ndarray, keys: pa.Array):
        self.seed, self.moves, self.keys = seed, moves, keys

    def find(self, asked: list[bytes]) -> np.ndarray:
        """Slot of each asked key, -1 where the stored key differs."""
        if not len(self.keys) or not asked:
            return np.full(len(asked), -1)
        h = _hashes(asked, self.seed)
        move = self.moves[(h % np.uint64(len(self.moves))).astype(np.int64)]
        slot = (_mixed(h, np.maximum(move, 0)) % np.uint64(len(self.keys))).astype(np.int64)
        slot = np.where(move < 0, -move - 1, slot)
        same = pc.equal(self.keys.take(pa.array(slot)), pa.array(asked, pa.binary()))
        return np.where(same.to_numpy(zero_copy_only=False), slot, -1)


def _place(keys: list[bytes]) -> np.ndarray:
    """A number of 31 bits; its remainder by the shards of a language is the shard of a key."""
    return (_hashes(keys, _SHARD_SEED) >> np.uint64(33)).astype(np.int64)


def perfect_hashes(vocabulary: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per (language, shard); a language of V terms has V / ``shard_keys`` shards, rounded up."""
    sizes = vocabulary.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).cast("int").alias("shards"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(_place(batch.column("term").cast(pa.binary()).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), batch.column("shards"), at], ["lang", "term", "shards", "at"])

    def build(table: pa.Table) -> pa.Table:
        keys = sorted(table.column("term").cast(pa.binary()).to_pylist())
        seed, moves, slots = build_hash(keys)
        placed: list = [None] * len(keys)
        for key, slot in zip(keys, slots.tolist()):
            placed[slot] = key
        named = table.select(["lang", "shards", "shard"]).slice(0, 1)
        own = {"seed": [seed], "n": [len(keys)], "moves": [moves.astype("<i8").tobytes()]}
        for name, kind in (("seed", pa.int64()), ("n", pa.int32()), ("moves", pa.binary())):
            named = named.append_column(name, pa.array(own[name], kind))
        return named.append_column("keys", pa.array([placed], pa.list_(pa.binary())).cast(pa.list_(pa.string())))

    placed = vocabulary.join(sizes, "lang").select("lang", "term", "shards").mapInArrow(
        place, "lang string, term string, shards int, at bigint"
    )
    placed = placed.select("lang", "term", "shards", (F.col("at") % F.col("shards")).cast("int").alias("shard"))
    return placed.groupBy("lang", "shard").applyInArrow(build, SHARDS)


# --- first pass ---------------------------------------------------------------------------------


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    none = F.lit("")
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), none).alias("lang"), F.coalesce(F.col(source_col).cast("string"), none).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), none).alias("text"),
    )


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py()


def kept_terms(plain: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) in at least so many documents of the language: partial counts per worker, then exact sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def handed_on():
            for lang, found in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "term", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch)):
                held[lang].update(set(terms(text)))
                if len(held[lang]) > HELD or len(held) > 1000:
                    yield from handed_on()
        yield from handed_on()

    partial = plain.select("lang", "text").mapInArrow(count, "lang string, term string, n bigint")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


# --- second pass --------------------------------------------------------------------------------


def _batch(lang: str, source: list[str], slot, term: pa.Array, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(slot, pa.int64()), term.cast(pa.string()), pa.array(n, pa.int64())],
        ["lang", "source", "slot", "term", "n"],
    )


def _tallied(plain_batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Counter]]:
    """Occurrences of terms by group, handed on while they are few."""
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)
    waiting = 0
    for batch in plain_batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch)):
            found = held[lang, source]
            before = len(found)
            found.update(terms(text))
            waiting += len(found) - before
            if waiting > HELD or len(held) > 1000:
                yield from ((*group, counts) for group, counts in held.items())
                held.clear()
                waiting = 0
    yield from ((*group, counts) for group, counts in held.items())


def _emptied(dense: dict, keys: pa.Array, base: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """The counted slots ``first`` to ``last`` of all groups, whose keys these are."""
    for (lang, source), slots in dense.items():
        at = np.flatnonzero(slots[first:last])
        if len(at):
            yield _batch(lang, [source] * len(at), base + at, keys.take(pa.array(at)), slots[first + at])


def _count_with_all(plain: DataFrame, shards: list) -> DataFrame:
    """Counts with all shards at every worker: one dense array of slots per group, emptied when many slots are in use."""
    sent = plain.sparkSession.sparkContext.broadcast(shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = defaultdict(list)
        many, size = {}, Counter()
        for lang, shards, number, base, seed, moves, keys in sent.value:
            many[lang] = shards
            size[lang] += len(keys)
            by_lang[lang].append((number, base, Shard(seed, np.frombuffer(moves, "<i8"), keys)))
        dense, used = {}, 0

        def emptied():
            for lang, own in by_lang.items():
                of_lang = {group: slots for group, slots in dense.items() if group[0] == lang}
                for _, base, shard in own:
                    yield from _emptied(of_lang, shard.keys, base, base, base + len(shard.keys))
            dense.clear()

        for lang, source, found in _tallied(batches):
            if lang not in many:
                continue
            slots = dense.get((lang, source))
            if slots is None:
                if used > 20 * HELD:
                    yield from emptied()
                    used = 0
                slots = dense[lang, source] = np.zeros(size[lang], np.int64)
                used += size[lang]
            keys, counts = list(found), np.fromiter(found.values(), np.int64, len(found))
            at = _place(keys) % many[lang]
            for number, base, shard in by_lang[lang]:
                mine = np.flatnonzero(at == number)
                slot = shard.find([keys[i] for i in mine.tolist()])
                hit = slot >= 0
                slots[base + slot[hit]] += counts[mine[hit]]
        yield from emptied()

    return plain.mapInArrow(count, COUNTS)


def _count_by_shard(plain: DataFrame, hashes: DataFrame) -> DataFrame:
    """Counts where each shard goes to one task: the terms' partial counts follow it there."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, source, found in _tallied(batches):
            keys = list(found)
            yield _batch(lang, [source] * len(keys), _place(keys), pa.array(keys, pa.binary()), list(found.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lang, base, dense, used = None, None, 0, {}, 0
        for batch in batches:
            flags = np.asarray(batch.column("is_count").cast(pa.int8()))
            heads = [*np.flatnonzero(flags == 0).tolist(), batch.num_rows]
            for start, stop in zip([0, *(h + 1 for h in heads[:-1])], heads):
                part = batch.slice(start, stop - start)
                if part.num_rows:
                    slot = shard.find(part.column("term").cast(pa.binary()).to_pylist())
                    sources, n = part.column("source").to_pylist(), np.asarray(part.column("n"))
                    hit = np.flatnonzero(slot >= 0)
                    names = np.array([sources[i] for i in hit.tolist()], object)
                    for name in set(names.tolist()):
                        if (lang, name) not in dense:
                            if used > 20 * HELD:
                                yield from _emptied(dense, shard.keys, base, 0, len(shard.keys))
                                dense, used = {}, 0
                            dense[lang, name] = np.zeros(len(shard.keys), np.int64)
                            used += len(shard.keys)
                        own = hit[names == name]
                        np.add.at(dense[lang, name], slot[own], n[own])
                if stop < batch.num_rows:
                    if shard is not None:
                        yield from _emptied(dense, shard.keys, base, 0, len(shard.keys))
                    dense, used = {}, 0
                    head = batch.slice(stop, 1)
                    lang, base = head.column("lang")[0].as_py(), head.column("base")[0].as_py()
                    keys = head.column("keys")[0].values.cast(pa.binary())
                    shard = Shard(head.column("seed")[0].as_py(), np.frombuffer(head.column("moves")[0].as_py(), "<i8"), keys)
        if shard is not None:
            yield from _emptied(dense, shard.keys, base, 0, len(shard.keys))

    many = hashes.select("lang", "shards").distinct()
    counts = plain.mapInArrow(partial, COUNTS).join(many, "lang").select(
        "lang", (F.col("slot") % F.col("shards")).cast("int").alias("shard"), F.lit(True).alias("is_count"), "source", "term", "n"
    )
    heads = hashes.select("lang", "shard", F.lit(False).alias("is_count"), "base", "seed", "moves", "keys")
    rows = heads.unionByName(counts, allowMissingColumns=True).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "is_count")
    return rows.mapInArrow(count, COUNTS)


def slot_counts(plain: DataFrame, vocabulary: DataFrame, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, slot, term, n): occurrences of the kept terms in each group, where there are any."""
    built = stored(perfect_hashes(vocabulary, shard_keys))
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = built.select("lang", "shard", "n").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
    hashes = built.join(bases.drop("n"), ["lang", "shard"])
    size = built.agg(
        F.sum(F.octet_length("moves") + F.aggregate("keys", F.lit(0).cast("bigint"), lambda t, k: t + F.octet_length(k) + 8)).alias("b")
    ).first()["b"] or 0
    if size <= broadcast_bytes:
        got = hashes.select("lang", "shards", "shard", "base", "seed", "moves", "keys").toArrow()
        rows = [
            (*(got.column(c)[i].as_py() for c in ("lang", "shards", "shard", "base", "seed", "moves")), got.column("keys")[i].values.cast(pa.binary()))
            for i in range(got.num_rows)
        ]
        counted = _count_with_all(plain, rows)
    else:
        counted = _count_by_shard(plain, hashes)
    return counted.groupBy("lang", "source", "slot", "term").agg(F.sum("n").alias("n"))


# --- divergence ---------------------------------------------------------------------------------


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), exact at any count."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.lit(1) + F.call_function("div", wide(n + PRIOR) * F.lit(SCALE), wide(total + kept * PRIOR))


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums of the differences of all pairs of sources that two parts have in a block of slots.

    A pair within one part goes by its names, as rows of a block come in any order.
    """
    width, a, b = (table.column(c)[0].as_py() for c in ("width", "a", "b"))
    names, part = table.column("source").to_pylist(), np.asarray(table.column("own"))
    shares = np.repeat(np.asarray(table.column("none"))[:, None], max(width, 1), axis=1) if width else np.zeros((len(names), 1), np.int64)
    for k, listed in enumerate(table.column("listed")):
        if listed.is_valid and len(listed):
            shares[k, np.asarray(listed.values.field("at"))] = np.asarray(listed.values.field("p"))
    x, y, f = [], [], []
    first, second = np.flatnonzero(part == a), np.flatnonzero(part == b)
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    for i in first:
        others = second[place[second] > place[i]] if a == b else second
        if len(others):
            x += [names[i]] * len(others)
            y += [names[j] for j in others]
            f += np.abs(shares[others] - shares[i]).sum(axis=1).tolist()
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "f": pa.array(f, pa.int64())})


def _pairs(groups: DataFrame, counts: DataFrame, block: int, sources: int) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    Slots are cut into blocks and sources into parts; a task holds two parts of
    one block, however many sources and terms there are.
    """
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("_k"))
    listed = counts.groupBy("lang", "source", F.floor(F.col("slot") / block).cast("int").alias("block")).agg(
        F.collect_list(F.struct((F.col("slot") % block).cast("int").alias("at"), "p")).alias("listed")
    )
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("kept") / block).cast("int"), F.lit(1)) - 1)
    own = F.pmod(F.xxhash64("source"), F.col("_k")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda p: F.struct(F.least("own", p).alias("a"), F.greatest("own", p).alias("b")))
    rows = (
        groups.join(many, "lang").withColumn("own", own).withColumn("block", F.explode(blocks))
        .join(listed, ["lang", "source", "block"], "left")
        .withColumn("width", F.least(F.lit(block), F.col("kept") - F.col("block") * block).cast("int"))
        .withColumn("_m", F.explode(meets))
        .select("lang", "source", "own", "block", "width", "none", "listed", "_m.a", "_m.b")
    )
    sums = rows.groupBy("lang", "block", "a", "b").applyInArrow(_pair_sums, "lang string, x string, y string, f bigint")
    once = sums.groupBy("lang", "x", "y").agg(F.sum("f").alias("value"))
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    return once.select("lang", both.alias("_p"), "value").select("lang", "_p.source", "_p.item", "value")


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    shard_keys: int = SHARD_KEYS,
    broadcast_bytes: int = BROADCAST_BYTES,
    block: int = BLOCK,
    sources: int = SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of the audit.

    Part ``pair``: the summed difference of shares to each other source of the
    language.  Part ``term``: the ``top`` terms a group has more of than its
    language, and by how much.
    """
    plain = _plain(docs, text_col, lang_col, source_col)
    vocabulary = stored(kept_terms(plain, least))
    found = stored(slot_counts(plain, vocabulary, shard_keys, broadcast_bytes))
    zero = F.lit(0).cast("bigint")
    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = stored(
        plain.select("lang", "source").distinct()
        .join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"))
        .withColumn("none", F.when(F.col("kept") > 0, _share(zero, F.col("total"), F.col("kept"))).otherwise(zero))
    )
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "slot", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    )
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    of_lang = found.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(by_lang, "lang").select(
        "lang", "slot", _share(F.col("n"), F.col("total"), F.col("kept")).alias("q")
    )
    more = shares.join(of_lang, ["lang", "slot"]).filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    terms_part = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs_part = _pairs(groups, shares, block, sources).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    return pairs_part.select(*names).unionByName(terms_part.select(*names))
