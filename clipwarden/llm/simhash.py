"""Near-duplicate groups by SimHash, joined on a grid of segment bit counts.

A fingerprint's 64 bits are cut into segments of two bits and replaced by their
bit counts.  The Manhattan distance of two count vectors never exceeds the
number of differing bits, so vectors further apart than the limit need no look
at the bits.  The grid join uses the halves of the vector: at most three steps
apart means that one half is at most one step apart.  Every fingerprint is
filed under both halves and looks in its own cell and those one step away;
what it meets is filtered by the distance of the whole vectors, then by the
bits themselves.  Equal fingerprints are one node, large cells are cut into
blocks, and each block hands on a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .text import LAST_ID, ascii_lower, blank_words, keyed, let, plain_id, row_key, stored

BITS_APART = 3
SHINGLE = 3
BLOCK = 1024  # fingerprints of one side of a cell that a block compares at once
_AT_ONCE = 200_000  # shingles whose bits are unpacked together


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each run of ``n`` lower-cased words, joined by blanks; of all words, if fewer."""

    def hashed(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        full = F.transform(heads, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)])))
        return (
            F.when(F.size(w) >= n, full)
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(blank_words(text), ascii_lower), hashed)


def fingerprints_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: the bits set in over half of them."""
    ones = np.zeros((len(sizes), 64), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        own = row[at : at + _AT_ONCE]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_ = 2 * ones > sizes[:, None]
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            hashes = part.column("hashes")
            sizes = np.diff(np.asarray(hashes.offsets)).astype(np.int64)
            fp = fingerprints_of(np.asarray(hashes.flatten()).view(np.uint64), sizes)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rk"), pa.array(fp)], ["id", "rk", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, fp); texts without words, and nulls, have fingerprint zero."""
    return (
        keyed(docs, id_col, text_col).select("id", "rk", shingle_hashes(F.col("text")).alias("hashes"))
        .mapInArrow(_fingerprints, "id bigint, rk bigint, fp bigint")
    )


_LOW_BITS = 0x5555555555555555


def counts_in_unary(fp: Column) -> Column:
    """The bit count of each two-bit segment as 00, 01 or 11: steps between counts are differing bits."""
    low = F.lit(_LOW_BITS)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _half(vector: Column, half: int) -> Column:
    return F.shiftrightunsigned(vector, 32) if half else vector.bitwiseAND(F.lit(0xFFFFFFFF))


def _one_step(cell: Column) -> Column:
    """The cell and those with one segment's count one up or down."""
    near = [F.struct(cell.alias("cell"), F.lit(True).alias("own"))]
    for i in range(16):
        low, high = F.lit(1 << (2 * i)), F.lit(2 << (2 * i))
        has_low, has_high = cell.bitwiseAND(low) != 0, cell.bitwiseAND(high) != 0
        # 00 <-> 01 flips the low bit unless the high one is set; 01 <-> 11 flips the high bit if the low one is set
        near.append(F.when(~has_high, F.struct(cell.bitwiseXOR(low).alias("cell"), F.lit(False).alias("own"))))
        near.append(F.when(has_low, F.struct(cell.bitwiseXOR(high).alias("cell"), F.lit(False).alias("own"))))
    return F.array_compact(F.array(*near))


def _forest(fps: np.ndarray, vectors: np.ndarray, own: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of one block between its own fingerprints and all in it."""
    owners, others = np.flatnonzero(own), np.arange(len(fps))
    label = np.arange(len(fps))
    links_a, links_b = [], []
    step = max(1, 1_000_000 // max(1, len(others)))
    for at in range(0, len(owners), step):
        rows = owners[at : at + step]
        near = np.bitwise_count(vectors[rows][:, None] ^ vectors[None, :]) <= limit  # Manhattan distance of the counts
        a, b = np.nonzero(near)
        a = rows[a]
        ok = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= limit)
        a, b = a[ok], b[ok]
        # what this part joins: labels fall to the least until nothing changes
        while len(a):
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (before == label).all():
                break
        links_a.append(a)
        links_b.append(b)
    if len(links_a) > 1:
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        while True:
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (before == label).all():
                break
    moved = np.flatnonzero(label != others)
    return list(zip(fps[label[moved]].view(np.int64).tolist(), fps[moved].view(np.int64).tolist()))


def _cell_links(limit: int):
    names = ("half", "cell", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block may go over several batches."""
        rest: pa.Table | None = None

        def links(table: pa.Table):
            columns = [np.asarray(table.column(n)) for n in names]
            fps, vectors = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("vector")).view(np.uint64)
            own = np.asarray(table.column("own"))
            if not len(fps):
                return
            new = np.zeros(len(fps), bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(fps)]
            pairs = []
            sizes = ends - starts
            owners = np.add.reduceat(own.astype(np.int64), starts)
            small = (sizes <= 24) & (owners > 0) & (sizes > 1)
            # blocks of a few rows together: every row with every own row of its block
            who = np.flatnonzero(small)
            if len(who):
                s, n = starts[who], sizes[who]
                row = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                block = np.repeat(np.arange(len(who)), n)
                reps = n[block]
                left = np.repeat(row, reps)
                right = np.repeat(s[block], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                ok = own[left] & (left != right) & (np.bitwise_count(vectors[left] ^ vectors[right]) <= limit)
                left, right = left[ok], right[ok]
                ok = np.bitwise_count(fps[left] ^ fps[right]) <= limit
                pairs.append((fps[left[ok]].view(np.int64), fps[right[ok]].view(np.int64)))
            for k in np.flatnonzero(~small & (owners > 0) & (sizes > 1)):
                a, b = starts[k], ends[k]
                found = _forest(fps[a:b], vectors[a:b], own[a:b], limit)
                if found:
                    pairs.append(tuple(np.array(x, np.int64) for x in zip(*found)))
            if pairs:
                a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            same = np.ones(table.num_rows, bool)
            for n in names:
                c = np.asarray(table.column(n))
                same &= c == c[-1] if len(c) else same
            last = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            yield from links(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from links(rest)

    return run


def links(nodes: DataFrame, limit: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``fp`` of ``nodes`` as all links would; limit at most 3."""
    if not 0 <= limit <= 3:
        raise ValueError("the halves of the grid serve up to three differing bits")
    filed = nodes.select("fp", counts_in_unary(F.col("fp")).alias("vector")).select(
        "fp", "vector",
        F.explode(F.array(*[F.struct(F.lit(h).alias("half"), _half(F.col("vector"), h).alias("cell")) for h in (0, 1)])).alias("_h"),
    )
    looks = filed.select("fp", "vector", "_h.half", F.explode(_one_step(F.col("_h.cell"))).alias("_c")).select(
        "half", F.col("_c.cell").alias("cell"), "fp", "vector", F.col("_c.own").alias("own")
    )
    sizes = looks.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("own"), 1)).alias("m"))
    # cells that nobody lives in link nothing; large ones are cut into blocks of own rows by blocks of all rows
    large = sizes.filter(F.col("n") > 2 * block).select(
        "half", "cell", F.ceil(F.greatest("m", F.lit(1)) / block).cast("int").alias("_m"), F.ceil(F.col("n") / block).cast("int").alias("_n")
    )
    cut = looks.join(large, ["half", "cell"], "left")
    spread = F.xxhash64("fp")
    m, n = F.coalesce("_m", F.lit(1)), F.coalesce("_n", F.lit(1))
    mine, any_ = F.pmod(spread, m).cast("int"), F.pmod(F.shiftright(spread, 20), n).cast("int")
    as_own = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(mine.alias("a"), b.alias("b"), F.lit(True).alias("own"))))
    as_any = F.transform(F.sequence(F.lit(0), m - 1), lambda a: F.struct(a.alias("a"), any_.alias("b"), F.lit(False).alias("own")))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("own").alias("own")))
    blocks = F.when(F.col("_m").isNull(), one).when(F.col("own"), F.concat(as_own, as_any)).otherwise(as_any)
    rows = cut.select("half", "cell", "fp", "vector", F.explode(blocks).alias("_b")).select(
        "half", "cell", F.col("_b.a").alias("a"), F.col("_b.b").alias("b"), "fp", "vector", F.col("_b.own").alias("own")
    )
    keys = ["half", "cell", "a", "b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cell_links(limit), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BITS_APART) -> DataFrame:
    """One row per document: doc_id, rk, fp, component_id, component_rk.

    ``component_id`` is the smallest id reachable over links of at most
    ``limit`` differing bits (``component_rk`` tells rows of one id apart).
    Null texts and texts without words have fingerprint zero and link like any
    other; a null id counts as the largest.
    """
    marked = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(marked.groupBy("fp").agg(F.min(F.struct("id", "rk")).alias("first")))
    labels = components(links(nodes.select("fp"), limit), "a", "b")
    joined = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    heads = joined.groupBy("label").agg(F.min("first").alias("head"))
    named = joined.join(heads, "label").select("fp", "head")
    return marked.join(named, "fp").select(
        plain_id().alias("doc_id"), "rk", "fp",
        F.when(F.col("head.id") != LAST_ID, F.col("head.id")).alias("component_id"), F.col("head.rk").alias("component_rk"),
    )


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BITS_APART) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns."""
    found = near_duplicates(docs, id_col, text_col, limit)
    heads = found.filter(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("rk") == F.col("component_rk"))
    ).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_cw_id"), F.col("rk").alias("_cw_rk")).distinct()
    tagged = docs.withColumns({"_cw_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "_cw_rk": row_key(id_col, text_col)})
    return tagged.join(heads, ["_cw_id", "_cw_rk"]).dropDuplicates(["_cw_id", "_cw_rk"]).select(*docs.columns)
