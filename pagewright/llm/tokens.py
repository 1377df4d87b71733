"""Byte-level BPE ids of whole texts, and the exact histogram of encoded lengths.

A byte-level vocabulary splits a text into pieces that never reach over a single space between
two characters that are not white space. Texts are therefore cut at such spaces and the
ids of each distinct chunk are kept, so that common words are encoded once per worker. Texts
that hold the string of a special token are encoded as a whole by the tokenizer itself.

Null and empty texts have no ids. Nothing else is read from the table but the text, so
further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import keep

#: Chunks whose ids a worker keeps; beyond it the cache starts anew. It bounds memory, not results.
MOST_CHUNKS = 400_000
LONGEST_KEPT = 64
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TextEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes; equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.chunks: dict[str, bytes] = {}
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and not spec.get("post_processor") and spec["model"]["type"] == "BPE"
        self.fast = None
        if plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            import tiktoken
            from public_tokenizers import PATTERN

            of = _byte_alphabet()
            ranks = {
                bytes(map(of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special
            }
            self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def _slow(self, words: list[str], text: str) -> bytes:
        """Encodes what is new; a text with other white space is cut by the full rule."""
        if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            words = _SINGLE_SPACE.split(text)
        kept = self.chunks
        if len(kept) > MOST_CHUNKS:
            kept.clear()
        out = [self._chunk(words[0])]
        for w in words[1:]:
            ids = kept.get(w)
            if ids is None:
                ids = self._chunk(" " + w)
                if len(w) <= LONGEST_KEPT and w and not w[0].isspace() and not w[-1].isspace():
                    kept[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            return self._exact(text)
        words = text.split(" ")
        head = words[0]
        try:
            rest = b"".join(map(self.chunks.__getitem__, words[1:]))
        except KeyError:
            return self._slow(words, text)
        if not head or head[-1].isspace():
            return self._slow(words, text)
        return self._chunk(head) + rest


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file."""
    return TextEncoder(path)


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Lengths and how many texts of each batch have them."""
    encode = encoder(path).encode
    for batch in batches:
        found: dict[int, int] = {}
        column = batch.column(0)
        for first in range(0, len(column), 256):
            for text in column.slice(first, 256).to_pylist():
                n = len(encode(text)) // 4
                found[n] = found.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())}
        )


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): the exact number of texts of each encoded length. Counts merge before the shuffle."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(
        lambda it: _lengths(it, tokenizer), "length long, n long"
    )
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_limits(histogram: DataFrame, block: int = 512) -> DataFrame:
    """Totals for every context limit, by suffix sums over the histogram.

    One row per length L that occurs: n_docs texts of just that length; docs_at_least and
    tokens_at_least over texts of L or more tokens; truncated_total, the tokens left if
    every text is cut to L; docs_up_to, the rank that answers quantiles (the q-quantile
    is the least L with docs_up_to >= q * total). Between two lengths truncated_total grows
    by the upper one's docs_at_least a token, so the rows answer every limit (``at_limits``,
    ``quantiles``). An empty histogram gives no rows.

    Suffix sums run within blocks of lengths; only one row a block is summed across blocks. The histogram is
    stored first, as both use it and texts are to be encoded once.
    """
    h = keep(histogram, "histogram").withColumn("block", F.floor(F.col("length") / block)).withColumn(
        "tokens", F.col("length") * F.col("n_docs")
    )
    per_block = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    after = per_block.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(after, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias(
            "truncated_total"
        ),
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        "all_docs",
        "all_tokens",
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of the texts does not exceed. Shares are over 0 and at most 1."""
    asked = limits.select("length", "docs_up_to", "all_docs", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    return asked.where(F.col("docs_up_to") >= F.col("share") * F.col("all_docs")).groupBy("share").agg(F.min("length").alias("length"))


def at_limits(limits: DataFrame, windows: list[int]) -> DataFrame:
    """(window, docs_over, truncated_total) for any context limits: texts longer than it, and the tokens left if texts are cut to it."""
    asked = limits.select("*", F.explode(F.array(*(F.lit(w).cast("long") for w in windows))).alias("window"))
    over, size = F.col("length") > F.col("window"), F.least("length", "window") * F.col("n_docs")
    return asked.groupBy("window").agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(size).alias("truncated_total"))
