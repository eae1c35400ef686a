"""Quality grades by ordinal regression (cumulative logits) on hashed text.

Grades 0 < 1 < 2: toxic, poor, good.  All thresholds share one weight vector
over hashed features: the distinct words, and bands of a few shares of the text
(words that end in a sign, in capitals, repeated at once, distinct words, length).
P(grade <= k) = logistic(threshold_k - score).  Words are hashed by Spark; the
fit is on a bounded sample of labelled rows, the scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .text import blank_words, keyed

SAMPLE_ROWS = 5_000  # labelled rows the fit looks at, at most
MIN_ROWS = 8  # a word of fewer sampled rows gets no weight; of small samples down to 3, one row in 500
MAX_FEATURES = 200_000  # words with a weight, the most frequent first
GRADES = 3
KEEP_AT_LEAST = 0.6  # probability of the highest grade from which a document stays

SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
BANDS = 12
_BAND_KEYS = 8  # features that are bands of a share


def word_keys(text: Column) -> Column:
    """Hash of each word in lower case without signs at its ends."""
    return F.transform(blank_words(text), lambda w: F.xxhash64(F.lower(F.btrim(w, F.lit(SIGNS)))))


def word_marks(text: Column) -> Column:
    """Last character's code, plus 1000 for words whose second character is a capital."""
    return F.transform(
        blank_words(text),
        lambda w: (
            F.ascii(F.substring(w, -1, 1)) % 1000
            + F.when(F.substring(w, 2, 1).between("A", "Z"), F.lit(1000)).otherwise(F.lit(0))
        ).cast("smallint"),
    )


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows and the number of each."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    return np.asarray(lists.flatten()), sizes


def band_features(keys: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the band (0 to BANDS - 1) of each of the shares."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    last = marks % 1000
    sign = np.isin(last, np.frombuffer(SIGNS.encode(), np.uint8))
    soft = np.isin(last, [ord(c) for c in ".,;:?"])
    starts = np.cumsum(sizes) - sizes
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[starts[(sizes > 0)]] = False
    share = lambda flags: np.bincount(row, weights=flags, minlength=n) / np.maximum(sizes, 1)
    if len(keys):
        order = np.lexsort((keys, row))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], weights=fresh, minlength=n) / np.maximum(sizes, 1)
    else:
        distinct = np.zeros(n)
    length = np.log2(sizes + 1)
    raw = [
        share(sign & ~soft), share(soft), share(marks >= 1000), share(same), distinct, share(last == ord("|")),
        distinct * np.minimum(1.0, np.sqrt(sizes) / 20),
    ]
    bands = [np.minimum((x * BANDS).astype(np.int64), BANDS - 1) for x in raw]
    bands.append(np.minimum(length.astype(np.int64), BANDS - 1))
    return np.stack(bands, axis=1)


@dataclass
class OrdinalModel:
    """Sorted word keys and their weights, weights of the bands, ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    bands: np.ndarray
    cuts: np.ndarray

    def scores(self, keys: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        row = np.repeat(np.arange(n), sizes)
        out = self.bands[np.arange(_BAND_KEYS), band_features(keys, marks, sizes)].sum(axis=1) if n else np.zeros(0)
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            pairs = np.unique(row[hit] * np.int64(len(self.keys)) + at[hit])
            out = out + np.bincount(pairs // len(self.keys), weights=self.weights[pairs % len(self.keys)], minlength=n)
        return out

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -60, 60)))


def fit(
    keys: np.ndarray, marks: np.ndarray, sizes: np.ndarray, grades: np.ndarray,
    steps: int = 300, rate: float = 0.1, penalty: float = 2e-4,
    min_rows: int = MIN_ROWS, max_features: int = MAX_FEATURES,
) -> OrdinalModel:
    """Penalised likelihood of the cumulative-logit model, by Adam over the whole sample."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    known, at = np.unique(keys, return_inverse=True)
    if len(known):
        at += row * np.int64(len(known))
    pairs = np.unique(at)  # each word once in a row
    del at, row
    prow, pat = (pairs // max(1, len(known))), (pairs % max(1, len(known)))
    del pairs
    rows_of = np.bincount(pat, minlength=len(known))
    frequent = np.flatnonzero(rows_of >= min(min_rows, max(3, n // 500)))
    frequent = np.sort(frequent[np.lexsort((frequent, -rows_of[frequent]))][:max_features])
    place = np.full(len(known), -1)
    place[frequent] = np.arange(len(frequent))
    held = place[pat] >= 0
    prow, pat = prow[held].astype(np.int32), place[pat[held]].astype(np.int32)
    bands = band_features(keys, marks, sizes)
    k = GRADES - 1
    share = np.array([np.clip((grades <= g).mean() if n else 0.5, 1e-3, 1 - 1e-3) for g in range(k)])
    first = np.log(share / (1 - share))
    # cuts are the first one and the logs of the steps between them, so they stay ordered
    params = [np.zeros(len(frequent)), np.zeros((_BAND_KEYS, BANDS)), np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-2))]]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    columns = np.arange(_BAND_KEYS)
    for step in range(1, steps + 1 if n else 1):
        w, b, c = params
        cuts = c[0] + np.r_[0.0, np.cumsum(np.exp(c[1:]))]
        score = np.bincount(prow, weights=w[pat], minlength=n) + b[columns, bands].sum(axis=1)
        edge = np.concatenate((np.full((n, 1), -50.0), np.clip(cuts[None, :] - score[:, None], -50, 50), np.full((n, 1), 50.0)), axis=1)
        below = 1 / (1 + np.exp(-edge))
        hi, lo = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        dscore = dhi - dlo  # of the negative log likelihood
        dcut = np.array([-(dhi[grades == g].sum() - dlo[grades == g + 1].sum()) for g in range(k)])
        dc = np.r_[dcut.sum(), np.exp(c[1:]) * np.cumsum(dcut[::-1])[::-1][1:]]
        db = np.zeros_like(b)
        for j in range(_BAND_KEYS):
            db[j] = np.bincount(bands[:, j], weights=dscore, minlength=BANDS)
        grads = [np.bincount(pat, weights=dscore[prow], minlength=len(w)) + penalty * w, db + penalty * b, dc]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            params[i] = params[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    w, b, c = params
    cuts = c[0] + np.r_[0.0, np.cumsum(np.exp(c[1:]))]
    return OrdinalModel(known[frequent], w, b, cuts)


def graded(labels: DataFrame, id_col: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(id, grade): 0 toxic, 1 poor, 2 good; one row per id, the lowest of several; rows with a null are left out."""
    grade = F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 1, 2).otherwise(1)
    return (
        labels.filter(F.col(id_col).isNotNull() & F.col(quality).isNotNull() & F.col(toxic).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(grade).alias("grade"))
    )


def fit_on(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **options
) -> OrdinalModel:
    """Fits on at most ``sample_rows`` labelled documents, those with the least hash of their id.

    Without labelled documents every document gets the middle of the scale.
    """
    chosen = graded(labels).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = (
        keyed(docs, id_col, text_col).join(chosen, "id")
        .dropDuplicates(["id", "rk"])
        .select("id", "rk", "grade", word_keys(F.col("text")).alias("k"), word_marks(F.col("text")).alias("m"))
        .orderBy("id", "rk").limit(sample_rows)
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task holds the sample: the driver, which goes on for long after the fit, gets the weights alone."""
        rows = pa.Table.from_batches(list(batches))
        sizes = np.diff(_offsets(rows.column("k")))
        keys, marks = (_values(rows.column(c)).astype(np.int64) for c in ("k", "m"))
        grades = rows.column("grade").to_numpy().astype(np.int64)
        del rows
        model = fit(keys, marks, sizes, grades, **options)
        yield pa.RecordBatch.from_pydict({n: pa.array([np.ravel(getattr(model, n)).tobytes()], pa.binary()) for n in _PARTS})

    one = rows.repartition(1).sortWithinPartitions("id", "rk").select("grade", "k", "m")
    found = one.mapInArrow(fitted, ", ".join(f"{n} binary" for n in _PARTS)).first()
    if found is None:
        none = np.empty(0, np.int64)
        return fit(none, none, none, none, **options)
    keys, weights, bands, cuts = (np.frombuffer(found[n], np.int64 if n == "keys" else np.float64) for n in _PARTS)
    return OrdinalModel(keys, weights, bands.reshape(_BAND_KEYS, BANDS), cuts)


_PARTS = ("keys", "weights", "bands", "cuts")


def _offsets(column) -> np.ndarray:
    ends = [0]
    for chunk in column.chunks:
        o = np.asarray(chunk.offsets)
        ends.extend((o[1:] - o[0] + ends[-1]).tolist())
    return np.asarray(ends, np.int64)


def _values(column) -> np.ndarray:
    parts = [np.asarray(chunk.flatten()) for chunk in column.chunks]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def score_columns(model: OrdinalModel, text_col: str = "text") -> Column:
    """A struct of expected_grade and tail (the probability of the highest grade)."""

    @F.arrow_udf("struct<expected_grade: double, tail: double>")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, marks in batches:
            parts = [np.empty((0, GRADES - 1))]
            for at in range(0, len(keys), 1000):
                k, sizes = _flat(keys.slice(at, 1000))
                m, _ = _flat(marks.slice(at, 1000))
                parts.append(model.above(model.scores(k, m.astype(np.int64), sizes)))
            above = np.concatenate(parts)
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["expected_grade", "tail"])

    return scored(word_keys(F.col(text_col)), word_marks(F.col(text_col)))


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP_AT_LEAST) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail and keep.

    A null text is graded as the empty text; null ids stay null; repeated rows
    get equal grades.
    """
    return docs.select(F.col(id_col).alias("doc_id"), score_columns(model, text_col).alias("_s")).select(
        "doc_id", "_s.expected_grade", F.col("_s.tail").alias("tail_probability"), (F.col("_s.tail") >= keep).alias("keep")
    )


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep: float = KEEP_AT_LEAST) -> DataFrame:
    """The documents whose probability of the highest grade is at least ``keep``, with their own columns."""
    return docs.withColumn("_cw_grade", score_columns(model, text_col)).filter(F.col("_cw_grade.tail") >= keep).select(*docs.columns)
