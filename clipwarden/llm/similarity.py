"""Near duplicates by the Jaccard similarity of five-word shingles, checked exactly.

This is the pipeline's stage ``simhash_near_dedup``.  Candidates come from
SimHash: fingerprints of the shingles, linked by the operator ``simhash`` where
at most three bits differ.  At similarity 0.8 about ten of 64 bits differ, and a
grid that finds ten bits compares a good part of all pairs; MinHash bands add
those candidates: texts that agree in all values of one band are tied to the
least of them.  The components of all ties hold together whatever a fingerprint
or a band has met.  Inside a component texts are compared by their whole sets of
shingle hashes, so a link is never a guess; only a pair that agrees in no band,
has fingerprints further apart and is not tied over others either is missed,
which at similarity 0.8 happens once in about 1,500 pairs at most.

A component of many texts is first taken apart: two sets this similar share one
of their rarest shingles (as many of each as the similarity leaves room for), so
texts that share none of them part ways.  Pages of one template, alike in what
many have and different in the rest, fall apart into single texts.  What stays
large are true groups of copies: some texts are compared with all others of the
component, round by round, until few are left that joined none of the large
group; these are compared with all.  The rows that travel grow with the texts,
not with their square.

Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import simhash
from .graph import components
from .simhash import shingle_hashes
from .text import LAST_ID, keyed, let, row_key, settled, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6  # 1 - (1 - 0.8^6)^24 = 0.9993
PART = 512  # texts of one part of a large component
ASKED = 64  # texts of a large component that the first round compares with all others; eight times as many each further round
ROUNDS = 2
_COLUMNS = 2048  # shingles that a block multiplies at once
_AT_ONCE = 200_000  # hashes whose minima are taken together

_draw = np.random.default_rng(5)
_FACTORS = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_TERMS = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64)
_FOLD = _draw.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the text's shingles; texts without words, and nulls, share one of their own."""
    alone = F.array(F.lit(0).cast("long"))
    return let(shingle_hashes(text, n), lambda h: F.when(F.size(h) > 0, h).otherwise(alone))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``_AT_ONCE`` hashes, one row at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + _AT_ONCE, "right")))
        yield first, last
        first = last


def _distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row sorted and without repeats, and their number."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.bincount(r[new], minlength=len(sizes))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat hashes and sizes of a column of non-empty lists."""
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    return np.asarray(column.flatten()).view(np.uint64), sizes


def _band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key per row and band, from the least values of the band's functions."""
    out, starts = np.empty((len(sizes), BANDS), np.uint64), np.cumsum(sizes) - sizes
    for band in range(BANDS):
        key = np.full(len(sizes), band, np.uint64)
        for k in range(ROWS):
            f = band * ROWS + k
            least = np.minimum.reduceat(hashes * _FACTORS[f] + _TERMS[f], starts)
            key = (key ^ (least ^ least >> np.uint64(31))) * _FOLD[k]
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few hashes at a time, so that a worker holds one batch of Spark's and little more."""
    for batch in batches:
        all_sizes = np.diff(np.asarray(batch.column("hashes").offsets)).astype(np.int64)
        for first, last in _slices(all_sizes):
            part = batch.slice(first, last - first)
            every, runs = _lists(part.column("hashes"))
            prints = simhash.fingerprints_of(every, runs)
            hashes, sizes = _distinct(every, runs)
            node = np.add.reduceat(hashes, np.cumsum(sizes) - sizes).view(np.int64)
            keys = pa.array(_band_keys(hashes, sizes).view(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), keys)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("rk"), pa.array(node), listed, pa.array(prints)], ["id", "rk", "node", "bands", "fp"]
            )


def _similar(hashes: np.ndarray, sizes: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an own row and a row whose sets have at least this similarity."""
    n, owners = len(sizes), np.flatnonzero(own)
    _, column, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = seen[column] > 1  # what one text alone has adds to no intersection
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(owners), n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        has = np.zeros((n, _COLUMNS), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has[owners] @ has.T
    together = sizes[owners][:, None] + sizes[None, :] - common
    a, b = np.nonzero(common >= least * together - 1e-6)
    a = owners[a]
    return a[a != b], b[a != b]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links, as (root, row)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return list(zip(label[moved].tolist(), moved.tolist()))


def _checked(least: float):
    names = ("label", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block may go over several batches."""
        rest: pa.Table | None = None

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            keys = [np.asarray(table.column(n)) for n in names]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            nodes, own = np.asarray(table.column("node")), np.asarray(table.column("own"))
            listed = table.column("hashes").combine_chunks()
            found = []
            for s, e in zip(starts.tolist(), np.r_[starts[1:], table.num_rows].tolist()):
                if e - s > 1:
                    a, b = _similar(*_distinct(*_lists(listed.slice(s, e - s))), own[s:e], least)
                    found += [(nodes[s + x], nodes[s + y]) for x, y in _forest(a, b, e - s)]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            other = np.any([np.asarray(table.column(n)) != table.column(n)[-1].as_py() for n in names], axis=0)
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            yield from links(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from links(rest)

    return run


def candidates(marked: DataFrame) -> DataFrame:
    """(node, label): the component of each node that shares a band with another or whose fingerprint links to another's."""
    filed = marked.select("node", F.explode("bands").alias("key"))
    prints = stored(marked.select("fp").distinct())
    linked = components(simhash.links(prints), "a", "b").select(F.col("node").alias("fp"), "label")
    near = marked.select("node", "fp").join(linked, "fp", "left").select("node", F.coalesce("label", "fp").alias("key"))
    return components(_ties(filed, ["key"]).unionByName(_ties(near, ["key"])), "node", "head")


def _ties(filed: DataFrame, keys: list[str]) -> DataFrame:
    """(node, head): each node of a key with the least node of it."""
    heads = filed.groupBy(*keys).agg(F.min("node").alias("head"), F.max("node").alias("_last")).filter(F.col("head") != F.col("_last"))
    return filed.join(heads.select(*keys, "head"), keys).filter(F.col("node") != F.col("head")).select("node", "head")


def _large(labels: DataFrame, part: int) -> DataFrame:
    """(label, n) of the components that don't fit one block."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * part)


def taken_apart(texts: DataFrame, labels: DataFrame, least: float = SIMILARITY, n: int = SHINGLE, part: int = PART) -> DataFrame:
    """(node, label) again, large components cut where no rare shingle holds them together.

    Sets of similarity ``least`` share one of the first ``size - ceil(least size) + 1``
    shingles in any common order; the order is by the number of texts in the component.
    """
    large = stored(_large(labels, part))
    if large.isEmpty():
        return labels
    own = labels.join(large.select("label"), "label", "left_semi")
    sets = stored(
        own.join(texts, "node").select("label", "node", F.explode(F.array_distinct(shingle_set(F.col("text"), n))).alias("h"))
    )
    seen = sets.groupBy("label", "h").agg(F.count(F.lit(1)).alias("seen"))
    # a shingle of one text alone joins nothing, but counts in the order
    by_rarity = sets.join(seen, ["label", "h"]).groupBy("label", "node").agg(F.array_sort(F.collect_list(F.struct("seen", "h"))).alias("s"))
    size = F.size("s")
    first = F.slice("s", 1, size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
    rare = by_rarity.select("label", "node", F.explode(first).alias("s")).filter("s.seen > 1").select("label", "node", F.col("s.h").alias("h"))
    return labels.join(large.select("label"), "label", "left_anti").unionByName(
        components(_ties(rare, ["label", "h"]), "node", "head").select("label", "node")
    )


def _blocks(rows: DataFrame, least: float, n: int) -> DataFrame:
    """Links (a, b) of blocks (label, a, b) of rows with node, text and ``own``: every own row with every row of its block."""
    keys = ["label", "a", "b"]
    return (
        rows.repartition(*keys).sortWithinPartitions(*keys)
        .select(*keys, "node", "own", shingle_set(F.col("text"), n).alias("hashes")).mapInArrow(_checked(least), "a bigint, b bigint")
    )


def _against_all(texts: DataFrame, chosen: DataFrame, all_: DataFrame, least: float, n: int, part: int) -> DataFrame:
    """Links between the chosen nodes (label, node, m: how many of the label) and all of their label (label, node, n)."""
    spread = F.xxhash64("node")
    mine = F.pmod(spread, F.ceil(F.col("m") / part)).cast("int")
    any_ = F.pmod(F.shiftright(spread, 20), F.ceil(F.col("n") / part)).cast("int")
    sizes = all_.select("label", "n").distinct().join(chosen.select("label", "m").distinct(), "label")
    many, parts = F.ceil(F.col("m") / part).cast("int"), F.ceil(F.col("n") / part).cast("int")
    own = chosen.drop("m").join(sizes, "label").select(
        "label", "node", F.lit(True).alias("own"), mine.alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("b")
    )
    rest = all_.drop("n").join(sizes, "label").select(
        "label", "node", F.lit(False).alias("own"), any_.alias("b"), F.explode(F.sequence(F.lit(0), many - 1)).alias("a")
    )
    placed = own.unionByName(rest)
    return _blocks(placed.join(texts, "node"), least, n)


def links(texts: DataFrame, labels: DataFrame, least: float = SIMILARITY, n: int = SHINGLE, part: int = PART, asked: int = ASKED) -> DataFrame:
    """(a, b): links that join the nodes of ``texts`` (node, text) as all similar pairs inside a component would."""
    large = stored(_large(labels, part))
    small = labels.join(large.select("label"), "label", "left_anti")
    zero = F.lit(0)
    found = _blocks(small.join(texts, "node").select("label", zero.alias("a"), zero.alias("b"), "node", F.lit(True).alias("own"), "text"), least, n)
    if large.isEmpty():
        return found
    links_found = stored(found)
    members = stored(labels.join(large, "label").select("label", "node", "n"))
    done = members.select("label", "node").limit(0)  # nodes that were compared with all
    left = members.select("label", "node")
    for turn in range(ROUNDS):
        few = left.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
        if few.filter(F.col("m") > part).isEmpty():
            break
        order, many = Window.partitionBy("label").orderBy(F.xxhash64("node", F.lit(turn)), "node"), asked * 8**turn
        chosen = left.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= many).select("label", "node")
        chosen = stored(chosen.withColumn("m", F.lit(many)))
        links_found = stored(links_found.unionByName(_against_all(texts, chosen, members.join(chosen.select("label").distinct(), "label"), least, n, part)))
        done = done.unionByName(chosen.select("label", "node"))
        left = _unjoined(members, links_found, done)
        if left.isEmpty():
            return links_found
    counted = left.join(left.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label")
    return links_found.unionByName(_against_all(texts, counted, members.join(counted.select("label").distinct(), "label"), least, n, part))


def _unjoined(members: DataFrame, found: DataFrame, done: DataFrame) -> DataFrame:
    """(label, node) of large components that are neither in its largest group of links nor compared with all, to be compared yet."""
    found = found.join(members.select(F.col("node").alias("a")), "a", "left_semi")
    groups = members.join(components(found, "a", "b").withColumnRenamed("label", "_g"), "node", "left").withColumn("_g", F.coalesce("_g", "node"))
    sizes = groups.groupBy("label", "_g").agg(F.count(F.lit(1)).alias("_s"))
    most = sizes.groupBy("label").agg(F.max_by("_g", F.struct("_s", "_g")).alias("_most"))
    left = groups.join(most, "label").filter(F.col("_g") != F.col("_most")).select("label", "node")
    return stored(left.join(done, ["label", "node"], "left_anti"))


def first_rows(rows: DataFrame, least: float = SIMILARITY, n: int = SHINGLE, part: int = PART) -> DataFrame:
    """(id, rk): the least of each group of ``rows`` (id, rk, text).  The result reads tables stored on the way."""
    spark = rows.sparkSession

    def distinct_sets() -> DataFrame:
        marked = stored(
            rows.select("id", "rk", shingle_set(F.col("text"), n).alias("hashes"))
            .mapInArrow(_sketch, "id bigint, rk bigint, node bigint, bands array<bigint>, fp bigint")
        )
        return marked.groupBy("node").agg(
            F.min(F.struct("id", "rk")).alias("first"), F.first("bands").alias("bands"), F.min("fp").alias("fp")
        )

    nodes = settled(spark, distinct_sets)
    met = settled(spark, lambda: candidates(nodes))
    wanted = nodes.join(met.select("node"), "node", "left_semi").select("node", "first.id", "first.rk")
    texts = stored(rows.join(wanted, ["id", "rk"]).dropDuplicates(["node"]).select("node", "text"))
    labels = settled(spark, lambda: taken_apart(texts, met, least, n, part))
    joined = components(links(texts, labels, least, n, part), "a", "b")
    return (
        nodes.join(joined, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("_f"))
        .select("_f.id", "_f.rk")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, n: int = SHINGLE, part: int = PART) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns.

    A group is what links of at least this Jaccard similarity join.  Texts of
    fewer than ``n`` words are one shingle; null texts and texts without words
    are alike; a null id counts as the largest; equal rows count once.
    """
    heads = settled(docs.sparkSession, lambda: first_rows(keyed(docs, id_col, text_col), least, n, part)).select(
        F.col("id").alias("_cw_id"), F.col("rk").alias("_cw_rk")
    )
    tagged = docs.withColumns({"_cw_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "_cw_rk": row_key(id_col, text_col)})
    return tagged.join(heads, ["_cw_id", "_cw_rk"]).dropDuplicates(["_cw_id", "_cw_rk"]).select(*docs.columns)
