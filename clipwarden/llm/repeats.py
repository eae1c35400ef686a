"""Passages repeated across documents, found level by level with doubled windows.

The windows of one level are twice as long as those of the level before (the
last level has the wanted length).  A window can only occur in two documents if
its two halves do, so only windows whose halves survived are tried at the next
level, until no candidates survive or the length is reached.  At the first
level not even every window is needed: of all windows inside a window of the
next level, the one with the least hash stands for the rest.

A level is one exchange.  Inside a chunk of documents equal windows are settled
on the spot: all copies but one leave as decided, in one packed row per
document, and one row goes on to meet the other chunks.  So a passage that a
third of all documents share costs one row per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import blank_words, keyed, plain_id

WORDS = 13
SHORTEST = 8  # the first level has at most so many words
CHUNK_WORDS = 1_500_000
SALTS = 1 << 16

ROWS = "key bigint, id bigint, rk bigint, decided binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def levels(words: int) -> list[int]:
    """Window lengths: halves of ``words``, rounded up, while longer than ``SHORTEST``."""
    out = [words]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(text: Column) -> Column:
    return F.transform(blank_words(text), lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (the last n - 1 are not windows)."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = _mixed(out * _MIX + words[i : i + len(out)])
    return out


def _starts_inside(sizes: np.ndarray, n: int) -> np.ndarray:
    """For each place in the joined documents whether a window of ``n`` words fits into its document."""
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(int(ends[-1]) if len(ends) else 0)
    return left >= n


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _first_candidates(words: np.ndarray, sizes: np.ndarray, n: int, longer: int) -> np.ndarray:
    """Places of the windows of ``n`` words that have the least hash in some window of ``longer`` words."""
    hashes = window_hashes(words, n)
    if longer == n:
        return np.flatnonzero(_starts_inside(sizes, n)[: len(hashes)])
    width = longer - n + 1
    least = _least_of(hashes, width)
    whole = _starts_inside(sizes, longer)[: len(least)]
    chosen = np.zeros(len(hashes), bool)
    for i in range(width):
        chosen[i : i + len(least)] |= whole & (hashes[i : i + len(least)] == least)
    return np.flatnonzero(chosen)


def _packed_runs(owner: np.ndarray, place: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each document in ``owner`` its mark, then (start, count) of the runs of its places."""
    order = np.lexsort((place, owner))
    o, p = owner[order], place[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    starts = np.flatnonzero(first)
    runs = np.stack((p[starts], np.diff(np.r_[starts, len(p)])), axis=1).astype("<i4")
    docs, at = np.unique(o[starts], return_index=True)
    return docs, [marks[d].tobytes() + r.tobytes() for d, r in zip(docs, np.split(runs, at[1:]))] if len(docs) else []


def _alive(hashes: np.ndarray, open_keys, decided, mark: int) -> np.ndarray:
    """Which of a document's windows survived, from the keys and the packed runs that came back."""
    flags = np.zeros(len(hashes), bool)
    if open_keys is not None and len(open_keys):
        flags |= np.isin(hashes, np.asarray(open_keys, np.int64).view(np.uint64))
    for blob in decided if decided is not None else ():
        if np.frombuffer(blob, "<i8", 1)[0] == mark:
            runs = np.frombuffer(blob, "<i4", offset=8).reshape(-1, 2)
            steps = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(steps, runs[:, 0], 1)
            np.add.at(steps, runs.sum(axis=1), -1)
            flags |= np.cumsum(steps[:-1]) > 0
    return flags


def _settle(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, last: bool) -> pa.RecordBatch:
    """Rows of one chunk: open (key, id, rk), witness (key, id) and decided (packed runs of a document)."""
    ids, rks, marks = (np.asarray(batch.column(c)) for c in ("id", "rk", "mark"))
    order = np.lexsort((owner, ids[owner], hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    group = np.cumsum(new) - 1
    h, o = h[new], o[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.r_[starts, len(h)])
    least = np.repeat(ids[o[starts]], counts)
    most = np.repeat(ids[o[starts + counts - 1]], counts)
    # last level: all but the smallest id are repeats; before: all, where two ids have the window
    sure = ids[o] > least if last else most > least
    gone = sure[group]
    docs, packed = _packed_runs(owner[order][gone], place[order][gone], marks)
    open_ = np.flatnonzero(~sure)
    open_ = open_[np.argsort(o[open_], kind="stable")]  # rows of a document stay together and pack better
    seen = np.flatnonzero(first & sure) if not last else open_[:0]
    spread = _mixed(_mixed(ids[docs].view(np.uint64) ^ _MIX) + rks[docs].view(np.uint64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((h[open_], h[seen], spread)).view(np.int64)),
            pa.array(np.concatenate((ids[o[open_]], ids[o[seen]], ids[docs]))),
            pa.array(
                np.concatenate((rks[o[open_]], np.zeros(len(seen), np.int64), rks[docs])),
                mask=np.repeat([False, True, False], [len(open_), len(seen), len(docs)]),
            ),
            pa.array([None] * (len(open_) + len(seen)) + packed, pa.binary()),
        ],
        ["key", "id", "rk", "decided"],
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded length; a document is never cut."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("w").offsets))
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > CHUNK_WORDS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("w")
    return np.asarray(column.flatten()).view(np.uint64), np.diff(np.asarray(column.offsets)).astype(np.int64)


def _owners(sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each place and the place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)[places]
    return owner, places - (np.cumsum(sizes) - sizes)[owner]


def _first_level(n: int, longer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            words, sizes = _words_of(batch)
            places = _first_candidates(words, sizes, n, longer)
            owner, inside = _owners(sizes, places)
            yield _settle(batch, window_hashes(words, n)[places], owner, inside, longer == n)

    return run


def _next_level(before: int, n: int, first: bool, longer: int):
    """Windows of ``n`` words of which the halves (at the first step: the least window inside) survived."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            words, sizes = _words_of(batch)
            old = window_hashes(words, before)
            alive = np.zeros(len(old), bool)
            ends = np.cumsum(sizes)
            back = zip(*(batch.column(c).to_pylist() for c in ("open", "decided", "mark")))
            for i, (o, d, mark) in enumerate(back):
                a, b = int(ends[i] - sizes[i]), int(ends[i] - before + 1)
                if b > a:
                    alive[a:b] = _alive(old[a:b], o, d, mark)
            count = max(0, len(words) - n + 1)
            whole = _starts_inside(sizes, n)[:count]
            if first:
                width = n - before + 1
                least = _least_of(old, width)[:count]
                ok = np.zeros(count, bool)
                for i in range(width):
                    ok |= alive[i : i + count] & (old[i : i + count] == least)
            else:
                ok = alive[:count] & alive[n - before : n - before + count]
            places = np.flatnonzero(ok & whole)
            owner, inside = _owners(sizes, places)
            yield _settle(batch, window_hashes(words, n)[places], owner, inside, longer == n)

    return run


def _met(rows: DataFrame, last: bool) -> DataFrame:
    """Per document the surviving keys: those that other documents have (at the last level, with a smaller id)."""
    same = Window.partitionBy("key")
    if last:
        alive = F.col("id") > F.col("_low")
    else:
        alive = (F.col("_low") < F.col("_high")) | F.col("_seen")
    return (
        rows.withColumns({
            "_low": F.min("id").over(same), "_high": F.max("id").over(same),
            "_seen": F.coalesce(F.max(F.col("rk").isNull()).over(same), F.lit(False)),
        })
        .filter(F.col("rk").isNotNull() & (F.col("decided").isNotNull() | alive))
        .groupBy("id", "rk").agg(
            F.collect_list(F.when(F.col("decided").isNull(), F.col("key"))).alias("open"),
            F.collect_set("decided").alias("decided"),
        )
    )


def repeated_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Keys of each document's windows that also start in a document with a smaller id: (id, rk, open, decided).

    ``docs`` has id, text and rk, by which rows of one id may be kept apart.
    Two rows with one id count as one document.
    """
    steps = levels(words)
    mark = F.xxhash64("text").alias("mark")
    one = docs.select("id", "rk", mark, word_hashes(F.col("text")).alias("w"))
    rows = one.mapInArrow(_first_level(steps[0], steps[min(1, len(steps) - 1)]), ROWS)
    for i in range(1, len(steps)):
        alive = _met(rows, False)
        rows = (
            docs.join(alive, ["id", "rk"])
            .select("id", "rk", mark, word_hashes(F.col("text")).alias("w"), "open", "decided")
            .mapInArrow(_next_level(steps[i - 1], steps[i], i == 1, words), ROWS)
        )
    return _met(rows, True)


def _removed(words: int):
    @F.pandas_udf("array<int>")
    def spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Removed runs as start, length, start, length, …"""
        for columns in batches:
            out = []
            for w, o, d, mark in zip(*columns):
                starts = np.empty(0, np.int64)
                if w is not None:
                    starts = np.flatnonzero(_alive(window_hashes(np.asarray(w).view(np.uint64), words), o, d, mark))
                if not len(starts):
                    out.append(None)
                    continue
                cut = np.flatnonzero(np.r_[True, np.diff(starts) > words])
                begin, end = starts[cut], starts[np.r_[cut[1:] - 1, len(starts) - 1]] + words
                out.append(np.stack((begin, end - begin), axis=1).ravel().astype(np.int32))
            yield pd.Series(out, dtype=object)

    return spans


def drop_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, removed (start, length, …) and kept_words.

    Every word in a window of ``words`` words that also starts in a document
    with a smaller id is removed.  A null text has no words, texts shorter than
    a window keep all; a null id counts as the largest; rows with one id do not
    count as repeats of each other.
    """
    # whether a window of a document goes depends on the document's id alone, so results may be kept by id;
    # a few bits of the text's hash beside it keep many rows of one id (or of none) apart
    base = (
        keyed(docs, id_col, text_col)
        .select("id", F.col("rk").bitwiseAND(F.lit(SALTS - 1)).alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("id", "rk")
    )
    found = repeated_windows(base, words)
    joined = base.join(found, ["id", "rk"], "left")
    hit = F.col("open").isNotNull()
    with_spans = joined.withColumn("_removed", _removed(words)(F.when(hit, word_hashes(F.col("text"))), F.col("open"), F.col("decided"), F.xxhash64("text")))
    cut = F.coalesce("_removed", F.array().cast("array<int>"))
    return (
        with_spans.select("id", blank_words(F.col("text")).alias("_w"), cut.alias("removed"))
        .select("id", F.size("_w").cast("long").alias("n_words"), "removed", _kept().alias("kept_words"))
        .select(plain_id().alias("doc_id"), "n_words", "removed", "kept_words")
    )


def _kept() -> Column:
    """Words outside the removed runs: the slices between them."""
    runs = F.size("removed") / 2
    pieces = F.transform(
        F.sequence(F.lit(0), runs.cast("int")),
        lambda k: F.slice(
            "_w",
            F.when(k == 0, F.lit(1)).otherwise(F.get("removed", 2 * k - 2) + F.get("removed", 2 * k - 1) + 1),
            F.when(k == runs.cast("int"), F.size("_w")).otherwise(F.get("removed", 2 * k))
            - F.when(k == 0, F.lit(0)).otherwise(F.get("removed", 2 * k - 2) + F.get("removed", 2 * k - 1)),
        ),
    )
    return F.flatten(pieces)


def removed_words(removed: Column) -> Column:
    """Number of removed words."""
    return F.aggregate(
        F.transform(removed, lambda x, i: F.when(i % 2 == 1, x).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x
    )
