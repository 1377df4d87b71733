"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of word shingles (five words; words are runs of ASCII letters and digits and
of characters above ASCII, lower-cased). A document holds an item if it has at least ``share`` of
the item's distinct shingles. An item of fewer words is one shingle, its whole sequence, and a document holds it where its
words stand consecutively.

1. Items are partitioned by the size of their sets (powers of two). An item's sketch is its
   m smallest hashes, with one m for a partition: as many misses as its largest size allows, and SPARE more.
2. A document that holds the item lacks at most n - ceil(share * n) of its n shingles, so it must hit
   the sketch at least m minus that often. No item that reaches the share is missed, whatever the lengths of the document.
3. Pairs with enough hits are verified by containment of the shingles themselves.

DataFrame functions only. Items of the same words are one item until the end. Sketches are broadcast in blocks of a counted size, so
that no shingle of a document is shuffled that is not in a sketch; each block reads the documents again.
Documents with null ids, null or empty texts, and items without words match nothing. Repeated
rows give one pair. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import keep

#: Hits beyond the first that partitions ask for.
SPARE = 3
#: Sketch rows (16 bytes each) of a block of the index that is broadcast.
BLOCK_ROWS = 1_000_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _places(words: Column, size: int) -> Column:
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))


def hashed_shingles(words: Column, size: int) -> Column:
    """64-bit hashes of the shingles, repeats included; null if there are none."""
    return F.transform(_places(words, size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def shingles(words: Column, size: int) -> Column:
    return F.array_distinct(F.transform(_places(words, size), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def _by_size(words: Column, sizes: list[int], of: Callable[[Column, int], Column]) -> Column:
    """``of`` of each size, in one array; null if there is none."""
    if len(sizes) == 1:
        return of(words, sizes[0])
    found = F.flatten(F.array_compact(F.array(*(of(words, k) for k in sizes))))
    return F.when(F.size(found) > 0, found)


def _own_size(words: Column, size: int, of: Callable[[Column, int], Column]) -> Column:
    """``of`` an item: of the size, or of all its words if these are fewer."""
    out = of(words, size)
    for k in range(1, size):
        out = F.when(F.size(words) == k, of(words, k)).otherwise(out)
    return out


def sketches(items: DataFrame, size: int, share: float) -> DataFrame:
    """(item, n, need, h): a row for every hash of every item's sketch; items are (item, words)."""
    hashes = F.array_sort(F.array_distinct(_own_size(F.col("words"), size, hashed_shingles)))
    sets = items.select("item", hashes.alias("hashes")).where("hashes is not null").withColumn("n", F.size("hashes"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    sketch = F.least(F.col("n"), F.floor(largest * (1 - share) + 1e-9) + 1 + SPARE).cast("int")
    misses = F.col("n") - F.ceil(F.col("n") * share - 1e-9)
    sets = sets.select("item", "n", (sketch - misses).alias("need"), F.slice("hashes", F.lit(1), sketch).alias("sketch"))
    return sets.select("item", "n", "need", F.explode("sketch").alias("h"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    share: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment) of every document and item it holds."""
    if not 0 < share <= 1 or math.isnan(share):
        raise ValueError("share must be over 0 and at most 1")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    named = items.select(F.col(item_col).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    named = keep(named.withColumn("print", F.md5(F.array_join("words", " "))).distinct(), "items")
    tested = named.groupBy("print").agg(F.any_value("words").alias("words"))
    tested = keep(tested.withColumn("item", F.monotonically_increasing_id()), "tested")
    index = keep(sketches(tested, size, share), "sketches")
    # Sizes of shingles that documents have to be read by: at most as many as a shingle has words.
    short = named.where(F.size("words") < size).select(F.size("words").alias("k")).distinct().collect()
    sizes = sorted({size, *(r["k"] for r in short)})
    hashes = own.select("id", words_of(F.col("text")).alias("words"))
    hashes = hashes.select("id", F.explode(F.array_distinct(_by_size(F.col("words"), sizes, hashed_shingles))).alias("h"))
    blocks = max(1, math.ceil(index.count() / BLOCK_ROWS))
    hits = None
    for k in range(blocks):
        own_block = lambda h: F.pmod(h, F.lit(blocks)) == k  # noqa: B023, E731
        rows = hashes if blocks == 1 else hashes.where(own_block(F.col("h")))
        part = index if blocks == 1 else index.where(own_block(F.col("h")))
        found = rows.join(F.broadcast(part), "h").groupBy("id", "item", "n", "need").count()
        hits = found if hits is None else hits.unionByName(found)
    if blocks > 1:
        hits = hits.groupBy("id", "item", "n", "need").agg(F.sum("count").alias("count"))
    pairs = keep(hits.where("count >= need").select("id", "item").distinct(), "leaks")

    item_sets = tested.select("item", F.array_distinct(_own_size(F.col("words"), size, shingles)).alias("item_set"))
    suspects = own.join(pairs, "id", "left_semi").select("id", words_of(F.col("text")).alias("words"))
    suspects = suspects.select("id", F.array_distinct(_by_size(F.col("words"), sizes, shingles)).alias("doc_set"))
    shared = F.size(F.array_intersect("item_set", "doc_set"))
    found = suspects.join(pairs, "id").join(item_sets, "item")
    found = found.select("id", "item", shared.alias("n_shared"), F.size("item_set").alias("n_item"))
    found = found.where(F.col("n_shared") >= F.ceil(F.col("n_item") * share - 1e-9))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    found = found.groupBy("id", "item").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("m"))
    found = found.join(tested.select("item", "print"), "item").join(named.select("print", "item_id").distinct(), "print")
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "m.n_shared", "m.n_item", "m.containment").distinct()
