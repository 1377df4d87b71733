"""Word hashes and shingle sets of whole texts, vectorised over Arrow buffers.

Words are the runs of ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A word's hash is a
random table polynomial modulo 2**64 over its bytes, finished by a 64-bit mixer; a shingle's
hash mixes its words' hashes with their places. Sets are compared by these 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text goes alone.
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE, head: int | None = None
) -> tuple[np.ndarray, ...]:
    """Hashes of the words of consecutive texts, and each text's number of words.

    ``data`` is a uint8 array; text i is ``data[offsets[i]:offsets[i + 1]]``. ``outside`` marks
    the bytes between words. With ``head``, hashes of the words' first bytes come third.
    """
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        return _long_word_hashes(data, outside, head)
    counts = np.zeros(len(offsets) - 1, np.int64)
    nothing = (np.zeros(0, np.uint64), counts) + ((np.zeros(0, np.uint64),) if head else ())
    if len(data) == 0:
        return nothing
    inside = ~outside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(begin) == 0:
        return nothing
    length = end - begin
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(length.sum()) - np.repeat(start, length)
    powers = np.full(int(length.max()), _PRIME, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = _TABLE[data[inside]] * powers[place]
    counts = np.searchsorted(begin, offsets[1:]) - np.searchsorted(begin, offsets[:-1])
    words = mix(np.add.reduceat(terms, start) + length.astype(np.uint64))
    if head is None:
        return words, counts
    terms[place >= head] = 0
    return words, counts, mix(~np.add.reduceat(terms, start))


def _long_word_hashes(data: np.ndarray, outside: np.ndarray, head: int | None) -> tuple[np.ndarray, ...]:
    """Hashes of one long text by parts that end between words, so that the places take bounded memory."""
    parts, at = [], 0
    while at < len(data):
        to = _next_gap(data, outside, at + SLICE_BYTES)
        begin = at
        if to - at > 2 * SLICE_BYTES:  # it ends with a word of more than a part
            gaps = np.flatnonzero(outside[data[at : at + SLICE_BYTES]])
            begin = at + int(gaps[-1]) + 1 if len(gaps) else at
            parts.append(word_hashes(data[at:begin], np.array([0, begin - at]), outside, head))
            parts.append(_one_word_hash(data[begin:to], head))
        else:
            parts.append(word_hashes(data[at:to], np.array([0, to - at]), outside, head))
        at = to
    return tuple(sum(p) if k == 1 else np.concatenate(p) for k, p in enumerate(zip(*parts, strict=True)))


def _next_gap(data: np.ndarray, outside: np.ndarray, at: int) -> int:
    while at < len(data):
        gaps = np.flatnonzero(outside[data[at : at + SLICE_BYTES]])
        if len(gaps):
            return at + int(gaps[0])
        at += SLICE_BYTES
    return len(data)


def _one_word_hash(data: np.ndarray, head: int | None) -> tuple[np.ndarray, ...]:
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES]
        powers = np.cumprod(np.concatenate([power, np.full(len(part), _PRIME)]), dtype=np.uint64)
        total += (_TABLE[part] * powers[:-1]).sum(dtype=np.uint64)
        power = powers[-1:]
    found = mix(total + np.uint64(len(data))), np.ones(1, np.int64)
    if head is None:
        return found
    return *found, mix(~(_TABLE[data[:head]] * np.cumprod(np.concatenate([[np.uint64(1)], np.full(head - 1, _PRIME)]), dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True))


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole texts of a binary column as (bytes, offsets), of about SLICE_BYTES."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(max(i + 1, j), len(column))
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text of a binary column the sorted distinct hashes of its ``size``-word shingles.

    Fewer words: the whole sequence as one shingle. No words or null: an empty array.
    """
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    for data, offsets in slices(column):
        words, counts = word_hashes(data, offsets)
        whole = words * _PLACE[0]
        for k in range(1, size):
            whole[: len(words) - k] += words[k:] * _PLACE[k]
        whole = mix(whole)
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n == 0 or not valid[i + k]:
                yield np.zeros(0, np.uint64)
            elif n < size:
                yield mix(np.array([(words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.unique(whole[at : at + n - size + 1])
            at += n
        i += len(counts)
