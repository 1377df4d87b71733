"""Ordinal cumulative-link regression on graded ratings, over hashed text.

P(grade >= k | x) = sigmoid(w.x - t_k) with one weight vector w for all grades and ordered
thresholds t_1 < t_2 < ... Features are the presence of hashed words and of hashed word heads,
and graded frequencies of byte classes. The expected grade is the sum of the tail
probabilities; a document is kept when its tail probability for ``keep_grade`` is 0.5 or more.

The fit uses at most ``fit_rows`` labelled documents (those whose ids have the smallest hashes); scoring
covers every row. Ratings are by id, repeated ratings count by their lowest grade. Rows with a null id are
scored and cannot be rated. Null and empty texts, and texts without words, hold no evidence:
probabilities 0, not kept. Without any ratings, or with one grade only, there is no model:
probabilities are null and everything is kept. Equal rows are scored alike and all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shingles import SLICE_BYTES, slices, word_hashes

#: Hash buckets; the first STYLE of them are for byte frequencies.
BITS = 20
STYLE = 1 << 13
HEAD = 5
#: The documented bound of the labelled sample.
FIT_ROWS = 12_000

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _byte_counts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of 256 counts for each text; a text that is longer than a slice is counted by parts."""
    if len(sizes) == 1:
        parts = (data[at : at + SLICE_BYTES] for at in range(0, len(data), SLICE_BYTES))
        return sum((np.bincount(p, minlength=256) for p in parts), np.zeros(256, np.int64))[None, :]
    lines = np.repeat(np.arange(len(sizes)), sizes) * 256
    return np.bincount(lines + data, minlength=256 * len(sizes)).reshape(-1, 256)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a binary column the sorted indices of its features; none without words."""
    for data, offsets in slices(column):
        words, counts, heads = word_hashes(data, offsets, _OUTSIDE, HEAD)
        span = np.uint64((1 << BITS) - STYLE)
        both = np.stack([words % span, heads % span]).astype(np.int64) + STYLE
        sizes = np.diff(offsets)
        seen = _byte_counts(data, sizes)
        upper = seen[:, 65:91].sum(axis=1, keepdims=True)
        digits = seen[:, 48:58].sum(axis=1, keepdims=True)
        marks = np.concatenate([seen[:, :48], seen[:, 58:65], seen[:, 91:97], seen[:, 123:128], upper, digits], axis=1)
        share = np.floor(2 * np.log2(1 + 500 * marks / np.maximum(sizes, 1)[:, None])).astype(np.int64)
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n == 0:
                yield np.zeros(0, np.int64)
                continue
            found = np.unique(both[:, at : at + n])
            fresh = np.unique(words[at : at + n]).size / n
            style = np.flatnonzero(share[k])
            style = np.concatenate([style * 32 + share[k][style] + 64, [int(fresh * 20)], [32 + n.bit_length()]])
            yield np.concatenate([np.sort(style), found])
            at += n


@dataclass
class OrdinalModel:
    """``weights`` by bucket; ``thresholds`` ascend, one for each grade above the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(len(self.thresholds))
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[found].sum(dtype=float), -30, 30)))


def telling(index: np.ndarray, owner: np.ndarray, grades: np.ndarray, least: int, sigmas: float) -> np.ndarray:
    """Whether each bucket is in ``least`` rows or more, and as often on both sides of every grade only by chance."""
    count = _bucket_counts(index)
    found = np.zeros(1 << BITS, bool)
    for k in range(int(grades.max())):
        high = grades > k
        share = high.mean()
        if 0 < share < 1:
            above = _bucket_counts(index, high[owner])
            found |= np.abs(above - share * count) >= sigmas * np.sqrt(count * share * (1 - share) * (1 - count / len(grades))) + 1e-9
    return found & (count >= least)


def _bucket_counts(index: np.ndarray, chosen: np.ndarray | None = None, step: int = 1 << 20) -> np.ndarray:
    """How often each bucket is in ``index``, or in the chosen part of it; by parts, as counting widens what it counts."""
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(index), step):
        part = index[at : at + step]
        out += np.bincount(part if chosen is None else part[chosen[at : at + step]], minlength=1 << BITS)
    return out


def fit(
    index: np.ndarray, owner: np.ndarray, grades: np.ndarray, l2: float = 0.3, steps: int = 200, least: int = 4, sigmas: float = 3.0
) -> OrdinalModel:
    """Maximum penalised likelihood by full-batch gradients with per-weight step sizes (Adam).

    ``index`` are the features of all rows, ``owner`` the place of the row that each belongs to, in ``grades``. Buckets found in fewer than ``least`` rows, or whose frequency does not depend on the grade (``sigmas``
    standard errors), keep the weight 0, so that single documents teach nothing by heart.
    """
    top = int(grades.max())
    often = telling(index, owner, grades, least, sigmas)
    used = np.flatnonzero(often)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    told = often[index]
    owner, index = owner[told].astype(np.intp), place[index[told]].astype(np.intp)
    n = len(grades)
    goal = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    prior = np.clip(goal.mean(axis=0), 1e-3, 1 - 1e-3)
    first, gaps = -np.log(prior[0] / (1 - prior[0])), np.log(np.maximum(np.diff(-np.log(prior / (1 - prior))), 1e-2))
    weights = np.zeros(len(used))
    state = [np.zeros(len(used) + top), np.zeros(len(used) + top)]
    for step in range(1, steps + 1):
        thresholds = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(owner, weights[index], n)
        tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        rows_at = np.arange(n)
        likely = np.maximum(edge[rows_at, grades] - edge[rows_at, grades + 1], 1e-9)
        slope = tail * (1 - tail)
        sign = np.zeros((n, top))
        sign[grades > 0, grades[grades > 0] - 1] = 1
        sign[grades < top, grades[grades < top]] = -1
        pull = sign * slope / likely[:, None]  # d log likelihood / d (score - threshold)
        by_weight = np.bincount(index, pull.sum(axis=1)[owner], len(used)) - l2 * weights
        by_threshold = -pull.sum(axis=0)
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([by_weight, later[:1], later[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights = weights + move[: len(used)]
        first, gaps = first + move[len(used)], np.minimum(gaps + move[len(used) + 1 :], 5)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = weights
    return OrdinalModel(full, first + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            found = pa.array(list(features(part.column("text"))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "grade": part.column("grade"), "found": found})


def train(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> OrdinalModel | None:
    """Fits on up to ``fit_rows`` rated documents. ``ratings`` has columns id and grade (0 is worst)."""
    rated = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.where("text is not null").join(sample, "id")
    found = joined.mapInArrow(_featured, "id long, grade int, found array<int>").orderBy("id").limit(fit_rows).toArrow()
    column = found.column("found").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if found.num_rows else np.zeros(0, np.int32)
    told = sizes > 0
    grades = found.column("grade").to_numpy()[told].astype(np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    # Flat arrays of 32 bits: the sample is the largest thing that the driver holds.
    owner = np.repeat((np.cumsum(told) - 1).astype(np.int32), sizes)
    index = column.values.to_numpy()[column.offsets[0].as_py() :].copy()
    del found, column
    pa.default_memory_pool().release_unused()
    return fit(index, owner, grades)


def _scored(docs: DataFrame, model: OrdinalModel | None, keep_grade: int, columns: list[str], text_col: str) -> DataFrame:
    names = [f"c{k}" for k in range(len(columns))]
    if model is None:
        none = F.lit(None).cast("double").alias("expected_grade")
        own = [F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]
        return docs.select(*own, none, F.lit(None).cast("array<double>").alias("p_at_least"), F.lit(True).alias("keep"))
    base = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)),
        F.col(text_col).cast("binary").alias("scored_text"),
    )
    kinds = {f.name: f.dataType for f in base.schema}
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = min(keep_grade, len(model.thresholds)) - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                tails = np.array([own.tails(f) for f in features(part.column("scored_text"))])
                out = {n: part.column(n) for n in names}
                out["expected_grade"] = pa.array(tails.sum(axis=1))
                out["p_at_least"] = pa.array(list(tails), pa.list_(pa.float64()))
                out["keep"] = pa.array(tails[:, at] >= 0.5)
                yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{n} {kinds[n].simpleString()}" for n in names)
    return base.mapInArrow(scored, schema + ", expected_grade double, p_at_least array<double>, keep boolean")


def score(
    docs: DataFrame,
    model: OrdinalModel | None,
    keep_grade: int = 2,
    columns: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """The given columns with expected_grade, p_at_least (a tail probability per grade) and keep, which replace columns of these names."""
    own = ("expected_grade", "p_at_least", "keep")
    columns = [c for c in (docs.columns if columns is None else columns) if c not in own]
    return _scored(docs, model, keep_grade, columns, text_col).toDF(*columns, *own)


def kept(docs: DataFrame, model: OrdinalModel | None, keep_grade: int = 2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their own columns."""
    out = _scored(docs, model, keep_grade, docs.columns, text_col).where("keep")
    return out.drop("expected_grade", "p_at_least", "keep").toDF(*docs.columns)


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from 0/1 ratings: 0 toxic, 1 of low quality, 2 good. Null ratings give no grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
    grade = grade.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade"))
