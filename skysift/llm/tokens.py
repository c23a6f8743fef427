"""Words and word hashes of text batches, in numpy.

Word separators of every contract here are ASCII, so words are cut on the UTF-8
bytes. A word's 64-bit hash is the sum of mixed (byte, place) values; sums can be taken
block by block, so a batch of any length needs little working memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, np.uint64) + _C1
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64))


#: Everything but ASCII letters and the bytes of other letters.
NOT_LETTERS = np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)])


def hashed(words: list[str], gaps: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes of single lower-case words, as `word_hashes` gives them."""
    data = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, data)])
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets, lower=False, gaps=gaps)[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words among them.

    ``gaps`` says which (lowered) bytes part words.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data] if lower else data
    word = ~gaps[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = word[heads]
    starts = np.flatnonzero(begins)
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        first, last = np.searchsorted(starts, [a, b])
        owner = np.cumsum(begins[a:b]) + (first - 1)
        if last == 0:
            continue
        place = (np.arange(a, b) - starts[np.maximum(owner, 0)]).astype(np.uint64)
        value = (_BYTE[data[a:b]] ^ (place * _C1)) * _C2
        value = (value ^ (value >> np.uint64(32))) * _C3
        value[~word[a:b]] = 0
        cuts = starts[first:last] - a
        if first and (not len(cuts) or cuts[0]):
            sums[first - 1 : first] += value[: cuts[0] if len(cuts) else b - a].sum(dtype=np.uint64)
        if len(cuts):
            sums[first:last] += np.add.reduceat(value, cuts)
    return mixed(sums), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, bounds = word_hashes(*text_bytes(column))
    keys = mixed(np.arange(k, dtype=np.uint64)) | np.uint64(1)
    whole = max(0, len(words) - k + 1)
    runs = np.full(whole, k, np.uint64)
    for place in range(k):
        runs += words[place : place + whole] * keys[place]
    runs = mixed(runs)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * keys[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
