"""Fuzzy search for short licence notices.

A notice of at most ``k`` errors holds at least one of ``k + 1`` pieces of the phrase unchanged. The pieces are
searched exactly; around each hit the regex library's bounded-error matching verifies the phrase,
counts its edits and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: One error for so many characters of a phrase; shorter phrases are found exactly only.
CHARS_PER_ERROR = 9

_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label:string,first_word:bigint,n_words:bigint,edits:int>>"
)


class _Phrase:
    def __init__(self, words: str, label: str):
        self.words, self.label, self.errors = words, label, len(words) // CHARS_PER_ERROR
        cuts = [len(words) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.seeds = [(words[a:b].encode(), a) for a, b in zip(cuts[:-1], cuts[1:])]
        self.exact = f" {words} ".encode()
        bound = f"{{1<=e<={self.errors}}}" if self.errors else ""
        self.fuzzy = regex.compile(f"(?<= )(?:{regex.escape(words, literal_spaces=True)}){bound}(?= )", regex.BESTMATCH)

    def places(self, body: bytes) -> list[int]:
        out, at = [], body.find(self.exact)
        while at >= 0:
            out.append(at + 1)
            at = body.find(self.exact, at + 1)
        return out

    def near(self, body: bytes, taken: list[int]) -> list[tuple[int, int, int]]:
        """Spans (start, end, edits) in bytes that are not exact and overlap no exact place or other span."""
        if not self.errors:
            return []
        windows, slack = [], 4 * self.errors + 1
        for seed, offset in self.seeds:
            at = body.find(seed)
            while at >= 0:
                windows.append((at - offset - slack, at - offset + len(self.words) + slack))
                at = body.find(seed, at + 1)
        exact, out = _Taken(), []
        fuzzy = _Taken()
        for a in taken:
            exact.add(a, a + len(self.words))
        for a, b in sorted(set(windows)):
            # Whole words only, so that no character is cut.
            a = body.rfind(b" ", 0, max(1, a + 1)) if a > 0 else 0
            b = body.find(b" ", min(b, len(body) - 1)) + 1
            window = body[a:b].decode()
            for hit in self.fuzzy.finditer(window):
                start = a + len(window[: hit.start()].encode())
                end = start + len(hit.group().encode())
                if exact.clear(start, end) and fuzzy.clear(start, end):
                    fuzzy.add(start, end)
                    out.append((start, end, sum(hit.fuzzy_counts)))
        return out


class _Taken:
    """Spans whose starts and ends ascend alike; new ones come nearly in order, so that each costs a search only."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)

    def clear(self, start: int, end: int) -> bool:
        last = bisect_left(self.starts, end) - 1
        return last < 0 or self.ends[last] <= start


def _scan(phrases: tuple[tuple[str, str], ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Phrase(*p) for p in phrases]
        schema = pa.schema([
            ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())]))),
        ])
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_SIGNS).split()
                body = b" " + b" ".join(words) + b" "
                blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
                starts, spans, base, best = [], [], set(), 0.0
                for phrase in known:
                    places = phrase.places(body)
                    for first in (np.searchsorted(blanks, places) - 1).tolist():
                        starts.append(first)
                        spans.append((phrase.label, first, phrase.words.count(" ") + 1, 0))
                        base.add(phrase.label)
                        best = 1.0
                    for a, b, edits in phrase.near(body, places):
                        first, last = np.searchsorted(blanks, [a, b]).tolist()
                        spans.append((phrase.label, first - 1, last - first + 1, edits))
                        best = max(best, 1 - edits / len(phrase.words))
                rows.append({
                    "id": key, "n_words": len(words), "n_base": len(starts),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted({s[0] for s in spans})), "score": best,
                    "spans": [dict(zip(("label", "first_word", "n_words", "edits"), s)) for s in sorted(spans, key=lambda s: s[1:])],
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scan


def notices(docs: DataFrame, phrases=PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_words``, ``n_base`` (exact places), ``first_word``, ``last_word``, ``base_labels``, ``labels``
    (exact and fuzzy), ``score`` (1 less the share of edits in the best place; 0 without one) and ``spans``.

    Words are lower-cased runs of letters and digits. A null or empty text has no words and no labels. A very long text takes time
    in proportion to its length and its hits.
    Rows are not merged; a null key stays null; other columns are not read.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return named.mapInArrow(_scan(tuple(phrases)), _SCHEMA).withColumnRenamed("id", key)
