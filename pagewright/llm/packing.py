"""Packing of token sequences by non-negative least squares over the length histogram.

1. Every text is encoded, closed by the end id and cut into full windows and one remainder.
2. The histogram of piece lengths (at most ``window`` rows) goes to the driver. All length
   combinations of up to three pieces that fill a window exactly are enumerated; their repeat counts
   x >= 0 minimise |A x - histogram| (multiplicative updates), and are rounded so that their running sum stays
   the same, and to what the histogram still holds. A tenth of each count is left to greedy best fit, which packs the
   residual lengths, again by count, and needs all lengths to choose from. Those of its sequences that are at most half full are
   taken apart once more and put to combinations that fill a smaller power of two, which need no padding.
3. The plan is a list of (combination, repeats), whose size depends on the window and not on the
   number of texts. Pieces of one length are ranked; ranks map to plan slots by binary search.

Ranks are taken inside (length, slice), with as many slices of a length as its count asks for, and slices are offset by
counts, so that one very common length is spread over many tasks. Null texts count as empty and give one piece, the end
id alone. Repeated ids and rows are packed like any others; a null id stays null. Further columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import keep
from pagewright.llm.tokens import encoder

#: Pieces of one length that are ranked together, and the part of all pieces that these are at most.
SLICE, SLICES = 50_000, 256
UPDATES = 100
#: Share of the solution that is rounded; greedy packing has the rest.
ROUNDED = 0.9


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, closing = encoder(path).encode, np.array([end], "<u4").tobytes()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            rows = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text) + closing)
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    rows.append((i, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            names = ("id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def combinations(lengths: np.ndarray, total: int) -> np.ndarray:
    """(n, 3) all ascending lengths, three at most, that sum to the total; zeros stand for fewer pieces."""
    there = np.zeros(total + 1, bool)
    there[lengths[lengths <= total]] = True
    there[0] = True
    out = [np.zeros((0, 3), np.int64)]
    for least in np.flatnonzero(there[: total // 3 + 1]):
        b = np.arange(least, (total - least) // 2 + 1)
        b = b[there[b] & there[total - least - b]]
        out.append(np.stack([np.full_like(b, least), b, total - least - b], axis=1))
    return np.concatenate(out)


def repeats(counts: np.ndarray, combos: np.ndarray, updates: int = UPDATES) -> np.ndarray:
    """Non-negative least squares of the histogram by multiplicative updates."""
    goal = counts.astype(float).copy()
    goal[0] = 0
    used = combos > 0
    top = goal[combos].sum(axis=1)
    x = np.where(used, goal[combos], np.inf).min(axis=1) / max(1.0, len(combos) / max(1, len(counts)))
    columns = [np.ascontiguousarray(c) for c in combos.T]
    for _ in range(updates):
        now = sum(np.bincount(c, x, len(counts)) for c in columns)
        now[0] = 0
        x = x * top / np.maximum(sum(now[c] for c in columns), 1e-12)
    return x


def filled(counts: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that are exactly ``total`` long; their pieces are taken off the counts."""
    combos = combinations(np.flatnonzero(counts), total)
    if not len(combos):
        return []
    steps = np.floor(np.cumsum(ROUNDED * repeats(counts, combos)) + 0.5).astype(np.int64)
    whole = np.diff(steps, prepend=0)
    out = []
    for k in np.flatnonzero(whole):
        parts = [p for p in combos[k].tolist() if p]
        if n := min(int(whole[k]), *(int(counts[p]) // parts.count(p) for p in parts)):
            out.append((tuple(parts), n))
            for p in parts:
                counts[p] -= n
    return out


def greedy(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) by best fit, longest piece first, that use all that the counts hold."""
    left = {int(p): int(counts[p]) for p in np.flatnonzero(counts)}
    order, out = sorted(left), []
    while order:
        parts, gap = [], window
        while order:
            k = bisect.bisect_right(order, gap) - 1
            while k >= 0 and left[order[k]] <= parts.count(order[k]):
                k -= 1
            if k < 0:
                break
            parts.append(order[k])
            gap -= order[k]
        n = min(left[p] // parts.count(p) for p in parts)
        out.append((tuple(parts), n))
        for p in set(parts):
            left[p] -= n * parts.count(p)
            if not left[p]:
                order.remove(p)
    return out


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram once; no lengths exceed the window."""
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = filled(counts, window)
    packed = greedy(counts, window)
    out += [(parts, n) for parts, n in packed if 2 * sum(parts) > window]
    counts[:] = 0
    for parts, n in packed:
        if 2 * sum(parts) <= window:
            for p in parts:
                counts[p] += n
    total = 1 << window.bit_length()
    while counts.any() and total > 1:
        total //= 2
        out += filled(counts, total) if total < window else []
    return out + greedy(counts, window)


def slots(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, offset; ascending by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = array("q"), 0
    for parts, n in found:
        offset = 0
        for p in parts:
            rows.extend((p, taken.get(p, 0), sequence, offset))
            taken[p] = taken.get(p, 0) + n
            offset += p
        sequence += n
    table = np.frombuffer(rows, np.int64).reshape(-1, 4) if rows else np.zeros((0, 4), np.int64)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = 1 << 44
    key = table[:, 0] * shift + table[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = np.searchsorted(key, length * shift + rank, "right") - 1
        columns = {c: batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")}
        columns["sequence_id"] = pa.array(table[at, 2] + rank - table[at, 1])
        columns["offset"] = pa.array(table[at, 3])
        yield pa.RecordBatch.from_pydict(columns)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = keep(base.mapInArrow(lambda it: _pieces(it, tokenizer, window, end_id), schema), "pieces")
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, window)))
    # A row for each length that occurs, the window's at most.
    most = max(1, min(SLICE, sum(histogram.values()) // SLICES))
    parts = spark.createDataFrame([(k, -(-n // most)) for k, n in histogram.items()], "length long, parts long")
    sliced = pieces.join(F.broadcast(parts), "length").withColumn("slice", F.pmod(F.xxhash64("id", "start"), F.col("parts"))).drop("parts")
    counts = keep(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "counts")

    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32")
    ranked = sliced.withColumn("within", F.row_number().over(inside) - 1).join(first, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("within")).drop("slice", "first", "within")
    out = ranked.mapInArrow(lambda it: _placed(it, table.value), schema + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
