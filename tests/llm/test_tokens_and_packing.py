"""Encoding against the tokenizer itself, the histogram against plain sums, packing by round trip."""

import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from pagewright.llm import packing
from pagewright.llm.packing import combinations, pack, plan, repeats, slots
from pagewright.llm.tokens import TextEncoder, at_limits, context_limits, length_histogram, quantiles

PATH = tokenizer_path("byte_bpe_50k.json")
ENCODER, WHOLE = TextEncoder(PATH), Tokenizer.from_file(PATH)
TEXTS = [None, "", "a", "Hello  world\n and more ", "x " * 3000, "<|endoftext|> and so", "日本語 テキスト" * 40, "tail\n"]


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "'s", "12", "é", "\x1c", "\x85", "\u3000", "\u00a0", "漢", "🙂", "<|endoftext|>", "...", "\r\n"]), max_size=14))
def test_ids_are_the_tokenizers_own(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == ids(text)


def test_context_limits(spark):
    docs = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, length int")
    lengths = [len(ids(t)) for t in TEXTS]
    rows = context_limits(length_histogram(docs, PATH), block=4).collect()
    assert {r["length"]: r["n_docs"] for r in rows} == Counter(lengths)
    for r in rows:
        n = r["length"]
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["docs_up_to"] == sum(x <= n for x in lengths)
        assert (r["all_docs"], r["all_tokens"]) == (len(lengths), sum(lengths))
    limits = context_limits(length_histogram(docs, PATH))
    low = sorted(lengths)
    found = {r["share"]: r["length"] for r in quantiles(limits, [0.25, 0.5, 1.0]).collect()}
    assert found == {q: min(x for x in low if sum(y <= x for y in low) >= q * len(low)) for q in (0.25, 0.5, 1.0)}
    found = {r["window"]: (r["docs_over"], r["truncated_total"]) for r in at_limits(limits, [0, 3, 100, 10**6]).collect()}
    assert found == {w: (sum(x > w for x in lengths), sum(min(x, w) for x in lengths)) for w in (0, 3, 100, 10**6)}
    assert context_limits(length_histogram(docs.limit(0), PATH)).count() == 0


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 3)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "s"), (3, "again", "s")]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string, slice string"), PATH, window=64).collect()
    expected = Counter()
    for i, t, _ in rows:
        whole = np.array([*ids(t), 1], "<u4")
        for start in range(0, len(whole), 64):
            piece = whole[start : start + 64]
            expected[i, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == expected
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 60), min_size=1, max_size=60))
def test_a_plan_uses_every_piece_once(histogram):
    found = plan(histogram, 128)
    used = Counter()
    for parts, n in found:
        assert sum(parts) <= 128
        for p in parts:
            used[p] += n
    assert used == Counter(histogram)
    table = slots(found)
    assert all(a[0] < b[0] or a[1] < b[1] for a, b in zip(table, table[1:], strict=False))


def test_combinations_are_all_of_three_pieces_at_most():
    lengths = [1, 2, 3, 5, 7, 8, 13, 20]
    expected = {(a, b, c) for a in [0, *lengths] for b in [0, *lengths] for c in [0, *lengths] if a <= b <= c and a + b + c == 20}
    assert {tuple(c) for c in combinations(np.array(lengths), 20).tolist()} == expected
    assert combinations(np.array([], int), 20).shape == (0, 3)


def padding(found, window):
    lost = sum(n * (window - sum(parts)) for parts, n in found if sum(parts) & (sum(parts) - 1))
    return lost / sum(n * sum(parts) for parts, n in found)


def test_fills_at_a_power_of_two_leave_no_padding():
    assert padding(plan({600: 3, 424: 3, 1024: 1, 200: 1, 312: 1}, 2048), 2048) == 0
    found = plan({1024: 3}, 2048)
    assert sorted(sum(parts) for parts, _ in found) == [1024, 2048]
    assert plan({}, 2048) == []


def test_little_padding_on_a_smooth_histogram():
    rng = np.random.Generator(np.random.PCG64(1))
    lengths = Counter((rng.lognormal(6.5, 0.8, 20000).astype(int) % 2047 + 1).tolist())
    found = plan(lengths, 2048)
    room = sum(n for _, n in found) * 2048
    assert sum(k * n for k, n in lengths.items()) / room > 0.995


def test_least_squares_lower_the_residual():
    counts = np.zeros(65, np.int64)
    counts[[10, 20, 34, 54, 44, 30]] = [30, 50, 30, 30, 50, 30]
    combos = combinations(np.flatnonzero(counts), 64)
    x = repeats(counts, combos)
    now = np.bincount(combos.ravel(), np.repeat(x, 3), 65)
    now[0] = 0
    assert (x >= 0).all() and np.abs(now - counts).sum() < 0.35 * counts.sum()
