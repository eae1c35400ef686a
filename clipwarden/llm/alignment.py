"""Which tokens of two tokenizers cover the same bytes, and how usual each link is.

Both token lists of a text end at byte offsets.  The ends of the shorter list
are searched in the longer by galloping: from the place of equal rank the step
doubles until the offset is passed, then the bracket is halved.  All searches of
a batch step together as array operations.  Ends found in both lists cut the
tokens into groups; the places found for two neighbouring ends bound the tokens
that one token overlaps.

The first pass writes each text's figures and its distinct id pairs.  Counts of
pairs are summed over all texts.  Pairs in at least 1 / ``HOT_PAIRS`` of all
(text, pair) rows are at most ``HOT_PAIRS``: they go to all workers.  Rows of the
others are joined with their counts, and no key of that join is frequent.

Null, empty and differently normalised texts have no tokens and zeros.  Each row
is a document, repeated rows too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .encoding import encoder, piece_encoder
from .text import stored

HOT_PAIRS = 1_000_000
_CHARACTERS = 200_000  # of texts aligned together
_TALLIED = 2_000_000  # pairs a worker counts together


def gallop(asked: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place of ``ends`` (rising) that is not below each asked offset, searched from ``start``."""
    n = len(ends)
    low, high = np.full(len(asked), -1), np.full(len(asked), n)
    at = np.clip(start, 0, n - 1)
    below = ends[at] < asked
    low[below], high[~below] = at[below], at[~below]
    going, step = np.flatnonzero(below), 1
    while len(going):
        place = low[going] + step
        past = (place >= n) | (ends[np.minimum(place, n - 1)] >= asked[going])
        high[going[past]] = np.minimum(place[past], n)
        low[going[~past]] = place[~past]
        going, step = going[~past], 2 * step
    going, step = np.flatnonzero(~below), 1
    while len(going):
        place = high[going] - step
        past = (place < 0) | (ends[np.maximum(place, 0)] < asked[going])
        low[going[past]] = np.maximum(place[past], -1)
        high[going[~past]] = place[~past]
        going, step = going[~past], 2 * step
    going = np.flatnonzero(high - low > 1)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = ends[middle] < asked[going]
        low[going[less]], high[going[~less]] = middle[less], middle[~less]
        going = going[high[going] - low[going] > 1]
    return high


def overlaps(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last token of ``long`` that each of ``short`` overlaps, and whether both end there.

    Both hold the ends of tokens over the same bytes, texts behind each other.
    """
    last = gallop(short, long, start)
    common = long[last] == short
    first = np.zeros_like(last)
    first[1:] = last[:-1] + common[:-1]
    return first, last, common


class _Aligner:
    def __init__(self, bpe_file: str, piece_file: str):
        self.a, self.b = encoder(bpe_file, True), piece_encoder(piece_file)
        vocabulary = self.a.tokenizer.get_vocab()
        byte = _byte_alphabet()
        self.entries_a: list[bytes] = [b""] * self.a.tokenizer.get_vocab_size()
        for entry, number in vocabulary.items():
            self.entries_a[number] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.entries_b = self.b.entries
        self.n_b = len(self.entries_b)
        self.sizes = [np.array([len(e) for e in entries], np.int64) for entries in (self.entries_a, self.entries_b)]
        # how an id is written inside a group, at its end, and (for the second list) at the end of the text
        self.written = [f"{i}{s}".encode() for i in range(len(self.entries_a)) for s in ",|"]
        self.first_b = len(self.written)
        self.written += [f"{i}{s}".encode() for i in range(self.n_b) for s in (",", ";", "")]

    def token_ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both lists of ids of each text; None where their bytes are not those of blank + text."""
        out = []
        for text, a, b in zip(texts, self.a.encode_after_blank(texts), self.b.encode(texts)):
            a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            raw = (" " + text).encode()
            same = (
                b"".join(map(self.entries_a.__getitem__, a.tolist())) == raw
                and b"".join(map(self.entries_b.__getitem__, b.tolist())) == raw
            )
            out.append((a, b) if same and text else None)
        return out

    def align(self, lists: list[tuple[np.ndarray, np.ndarray]], a_drives: bool):
        """Figures, digests and distinct pairs of texts of which all have the shorter list on one side."""
        ids = [np.concatenate([x[k] for x in lists]) for k in (0, 1)]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)]
        counts = [np.array([len(x[k]) for x in lists]) for k in (0, 1)]
        text_starts = [np.cumsum(c) - c for c in counts]
        s, o = (0, 1) if a_drives else (1, 0)
        rank = np.arange(len(ids[s])) - np.repeat(text_starts[s] - text_starts[o], counts[s])
        first, last, common = overlaps(ends[s], ends[o], rank)
        n = last - first + 1
        total = np.cumsum(n)
        left = np.repeat(np.arange(len(n)), n)
        right = np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(first, n)
        number = np.repeat(np.arange(len(lists)), counts[s])
        pair = ids[0][left if a_drives else right] * self.n_b + ids[1][right if a_drives else left]
        keys, times = np.unique(number[left] * (len(self.entries_a) * self.n_b) + pair, return_counts=True)
        of_text, pair = np.divmod(keys, len(self.entries_a) * self.n_b)
        links = np.add.reduceat(n, text_starts[s])
        groups = np.add.reduceat(common.astype(np.int64), text_starts[s])
        ends_of = [None, None]
        ends_of[s], ends_of[o] = np.flatnonzero(common), last[common]
        return counts, groups, links, self._digests(ids, ends_of, counts), pair, times, np.bincount(of_text, minlength=len(lists))

    def _digests(self, ids, ends_of, counts) -> list[str]:
        a_end, b_end = ends_of[0] + 1, ends_of[1] + 1
        a_begin, b_begin = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        written = 2 * ids[0]
        written[ends_of[0]] += 1
        codes[np.arange(len(ids[0])) + np.repeat(b_begin, a_end - a_begin)] = written
        written = self.first_b + 3 * ids[1]
        written[ends_of[1]] += 1
        written[np.cumsum(counts[1]) - 1] += 1
        codes[np.arange(len(ids[1])) + np.repeat(a_end, b_end - b_begin)] = written
        out, start = [], 0
        for size in (counts[0] + counts[1]).tolist():
            line = b"".join(map(self.written.__getitem__, codes[start : start + size].tolist()))
            out.append(hashlib.sha256(line).hexdigest())
            start += size
        return out


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_aligners: dict[tuple[str, str], _Aligner] = {}


def _aligner(bpe_file: str, piece_file: str) -> _Aligner:
    key = bpe_file, piece_file
    if key not in _aligners:
        _aligners[key] = _Aligner(*key)
    return _aligners[key]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for name, value in zip(batch.column("id"), batch.column("text")):
        ids.append(name.as_py())
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size > _CHARACTERS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def aligned(docs: DataFrame, bpe_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its number, id, counts of tokens, groups and links, digest of the groups, distinct pairs and how often each is there.

    A pair is ``a * size of B's vocabulary + b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(bpe_file, piece_file), TaskContext.get().partitionId() << 32
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            for ids, texts in _chunks(batch):
                lists = aligner.token_ids(texts)
                sides = ([k for k, x in enumerate(lists) if x and len(x[0]) <= len(x[1])], [k for k, x in enumerate(lists) if x and len(x[0]) > len(x[1])])
                for side, a_drives in zip((*sides, [k for k, x in enumerate(lists) if not x]), (True, False, None)):
                    if not side:
                        continue
                    if a_drives is None:
                        zero = np.zeros(len(side), np.int64)
                        (n_a, n_b), groups, links, digests, pair, times, sizes = (zero, zero), zero, zero, [""] * len(side), zero[:0], zero[:0], zero
                    else:
                        (n_a, n_b), groups, links, digests, pair, times, sizes = aligner.align([lists[k] for k in side], a_drives)
                    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + len(side))), pa.array([ids[k] for k in side], pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                            pa.array(groups, pa.int64()), pa.array(links, pa.int64()), pa.array(digests, pa.string()),
                            pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                        ],
                        names,
                    )
                    row += len(side)
        aligner.a.rest()
        aligner.b.rest()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>",
    )


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): texts that hold the pair linked, and whether no pair of its first id is in more."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in batches:
            held.append(np.asarray(batch.column("pairs").flatten()))
            size += len(held[-1])
            if size > _TALLIED:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = rows.select("pairs").mapInArrow(tally, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / n_b))
    # one row per entry of the first vocabulary
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _weighed(sent):
    """Sums over the hot pairs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = (np.frombuffer(raw, kind) for raw, kind in zip(sent.value, ("<i8", "<i8", "?")))
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("pairs").offsets))
            asked, times = np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten()).astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
            hit = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
            totals = []
            for value in ((best[at] & hit) * times, n[at] * hit * times) if len(pairs) else (np.zeros(len(asked), np.int64),) * 2:
                running = np.r_[0, np.cumsum(value)]
                stops = np.cumsum(sizes)
                totals.append(pa.array(running[stops] - running[stops - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *totals],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"],
            )

    return run


def _cold(sent):
    """(row, pair, times) of the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(sent.value[0], "<i8")
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("pairs").offsets))
            asked = np.asarray(batch.column("pairs").flatten())
            cold = np.ones(len(asked), bool)
            if len(pairs):
                cold = pairs[np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)] != asked
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.asarray(batch.column("row")), sizes)[cold]), pa.array(asked[cold]),
                    pa.array(np.asarray(batch.column("times").flatten())[cold], pa.int32()),
                ],
                ["row", "pair", "times"],
            )

    return run


def alignment(
    docs: DataFrame, bpe_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose pair is in as many texts as any pair of its
    first id, ``count_sum`` sums the texts of the pairs over the links.
    """
    rows = stored(aligned(docs, bpe_file, piece_file, id_col, text_col))
    counts = stored(pair_counts(rows, piece_encoder(piece_file).model.get_piece_size()))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = -(-total // hot_pairs)
    hot = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast(
        tuple(np.ascontiguousarray(hot.column(c).to_numpy(), kind).tobytes() for c, kind in (("pair", "<i8"), ("n", "<i8"), ("best", "?")))
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    figures = rows.mapInArrow(
        _weighed(sent),
        "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint",
    )
    if least <= 1:
        return figures.select(*names)
    rare = (
        rows.select("row", "pairs", "times").mapInArrow(_cold(sent), "row bigint, pair bigint, times int")
        .join(counts.filter(F.col("n") < least), "pair")
        .groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    )
    zero = F.lit(0).cast("bigint")
    return figures.join(rare, "row", "left").withColumns(
        {"n_best": F.col("n_best") + F.coalesce("_best", zero), "count_sum": F.col("count_sum") + F.coalesce("_sum", zero)}
    ).select(*names)
