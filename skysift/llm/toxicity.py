"""Toxicity of texts that may be disguised: noisy-channel restoration, then a score of the restored words.

Writers hide words by look-alike signs, spacing and repeated letters. A token that shows such signs is a
lattice of letters it may stand for; the best path under a character trigram model of the corpus and the
channel's costs is its restored form. Plain tokens have one path only and stand for themselves. Words, plain and
restored, are weighed by labelled documents, and a logistic model turns a text's weights into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.tokens import NOT_LETTERS, hashed, slices, text_bytes, word_hashes
from skysift.session import staged

#: Weights that go to every task, of the most telling words by likelihood ratio; the others are joined. Changes no result.
NEAR_WORDS = 100_000
#: Bits, by the first bits of a hash, of the words that are joined: only words whose bit is set are asked for.
FILTER_BITS = 24
#: Labelled documents at most that the logistic model is fitted on, chosen by a hash of their ids.
FIT_ROWS = 20_000
THRESHOLD = 0.7

_LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "#": "h",
}
_SIGNS = re.escape("".join(_LOOKS))
# What a letter left out saves in the character model, about; leaving out must not win by this alone.
_LETTER = -2.5
_SWAP, _ANY, _RARE, _HALF, _DROP = (math.log(p) for p in (0.3, 0.02, 0.05, 0.5, 0.005))
# What a sign costs that stays the sign it is, beside that of an edge of a word.
_SAME = math.log(0.05)
# What the end of a word costs at a gap between single letters.
_PART = math.log(0.25)
_EDGE, _OTHER, _SIZE = 26, 27, 28
_CODES = {"abcdefghijklmnopqrstuvwxyz "[i]: i for i in range(27)}
_LETTERS = rf"[a-z{_SIGNS}*]"
_TOKEN = re.compile(rf"{_LETTERS}+(?:[._-]{_LETTERS}+)*")
# A look-alike or filler beside a letter, a doubled letter, an inner separator, or signs alone that are no number.
_SUSPECT = re.compile(
    rf"[a-z][{_SIGNS}*]|[{_SIGNS}*][a-z]|([a-z])\1|{_LETTERS}[._-]{_LETTERS}|@[{_SIGNS}]{{2}}|[0-9]*[@$][0-9]*[@$]"
)
# What parts letters or words, and letters so parted, by blanks and line breaks as well.
_GAP = re.compile(r"[\s._-]+")
_WIDER = re.compile(r"[^\s._-]{2}")
_SPACED = re.compile(rf"(?<![^\W_])(?:[a-z{_SIGNS}][ \t\r\n._*-]{{1,3}}){{2,}}[a-z{_SIGNS}](?![^\W_])")
# Signs that are plain punctuation at either end of a token.
_ENDS = "!|$+(<*#"
# More stars than these inside a token are no letters.
_STARS = 7
_CACHED = 500_000
# Longer tokens are read as well, but not remembered.
_LONG = 100


def _symbols(data: np.ndarray) -> np.ndarray:
    table = np.full(256, _EDGE, np.int64)
    table[97:123], table[65:91], table[128:] = np.arange(26), np.arange(26), _OTHER
    return table[data]


# --- character model -------------------------------------------------------------------


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            s = _symbols(text_bytes(batch.column("text"))[0])
            if len(s) > 2:
                total += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(third | first two) over letters, an edge and one sign for all other letters: a fixed number of counts."""
    named = docs.select(F.col(text).cast("string").alias("text"))
    rows = named.mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.full((_SIZE, _SIZE, _SIZE), 0.1)
    for r in rows:
        counts.reshape(-1)[r["gram"]] += r["n"]
    return np.log(counts / counts.sum(2, keepdims=True))


class Decoder:
    """Viterbi over a token's lattice; states are the last two letters written, an edge between words counts as one."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.restored = lru_cache(100_000)(self._restored)
        self.known: dict[str, list[str]] = {}

    @staticmethod
    def _options(token: str, parted: bool) -> Iterator[list[tuple[str, float]]]:
        """For each sign what it may stand for, with log costs; the empty text leaves it out, a blank ends a word.

        A gap is left out; ``parted``, it may end a word as well, and so may a sign that is a sign.
        """
        head, tail = len(token) - len(token.lstrip(_ENDS)), len(token.rstrip(_ENDS))
        end = 0.0 if _WIDER.search(token) else _PART
        i = 0
        while i < len(token):
            c, size = token[i], 1
            if c in _LOOKS:
                same = [(" ", _SAME)] if parted else []
                left_out = _SAME if i < head or i >= tail else _DROP + _LETTER
                yield [(x, _SWAP) for x in _LOOKS[c]] + [("", left_out)] + same
            elif c == "*" or c.isalpha():
                while token[i + size : i + size + 1] == c:
                    size += 1
                if c.isalpha():
                    yield [(c, 0.0)]
                    more = [("", _HALF + _LETTER), (c, _HALF)] if size == 2 else [("", 0.0), (c, _RARE)]
                    yield from [more] * (size - 1)
                elif size > 1 and (i < head or i >= tail):
                    pass  # several at an end are markup, as a plain text has it
                elif size > _STARS:
                    yield [("", 0.0), (" ", 0.0)] if parted else [("", 0.0)]
                else:
                    yield from [[(chr(x), _ANY) for x in range(97, 123)] + [("", _HALF + _LETTER)]] * size
            else:
                size = _GAP.match(token, i).end() - i
                if parted:
                    yield [("", 0.0), (" ", end)]
            i += size

    def _unchanged(self, token: str) -> float:
        """What the token costs as it stands: its signs are edges, which part words."""
        score, a, b = 0.0, _EDGE, _EDGE
        for i, sign in enumerate([*token, " "]):
            c = ord(sign) - 97 if "a" <= sign <= "z" else _EDGE
            if c != _EDGE or b != _EDGE:
                score, a, b = score + self.model[a][b][c], b, c
            if c == _EDGE and i < len(token) and not sign.isspace():
                score += _SAME
        return score

    def _restored(self, token: str, parted: bool = False) -> list[str]:
        """The best readings of a token, of those that end in different letters; the first is the best.

        None that is far less likely than the token as it stands: its own words count anyway. ``parted`` ones hold that
        choice in themselves, sign by sign. A path is a chain of its letters, so time grows with the token's length only.
        """
        model = self.model
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(_EDGE, _EDGE): (0.0, None)}
        for options in self._options(token, parted):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            plain = None
            if len(options) == 1 and options[0][0] not in ("", " "):
                ((letter, cost),) = options
                plain = _CODES.get(letter, _OTHER)
            for (a, b), (score, path) in beam.items():
                likely = model[a][b]
                if plain is not None:
                    state, reached = (b, plain), score + cost + likely[plain]
                    if state not in after or reached > after[state][0]:
                        after[state] = (reached, (path, letter))
                    continue
                for letter, cost in options:
                    if not letter or letter == " " and b == _EDGE:
                        state, reached, way = (a, b), score + cost, path
                    else:
                        c = _CODES.get(letter, _OTHER)
                        state, reached, way = (b, c), score + cost + likely[c], (path, letter)
                    if state not in after or reached > after[state][0]:
                        after[state] = (reached, way)
            beam = after
        ends = sorted(
            ((score + (0.0 if b == _EDGE else model[a][b][_EDGE]), a, b) for (a, b), (score, path) in beam.items() if path), reverse=True
        )
        if not ends:
            return []
        least = (ends[0][0] if parted else max(ends[0][0], self._unchanged(token))) - 3
        return [self._written(beam[a, b][1]) for score, a, b in ends[:3] if score > least]

    @staticmethod
    def _written(path: tuple | None) -> str:
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def _readings(self, token: str) -> list[str]:
        """Words of the token read as one, of its parts, of each two neighbours, and with each gap either left out or the end of a word."""
        restored = self.restored if len(token) <= _LONG else self._restored
        found = restored(token)
        parts = _GAP.split(token)
        gaps = _GAP.findall(token) if len(parts) > 2 else []
        if gaps and min(map(len, gaps)) < max(map(len, gaps)):
            # Words of letters parted by narrow gaps.
            parts = re.split(rf"[\s._-]{{{min(map(len, gaps)) + 1},}}", token)
        if len(gaps) > 1:
            found = found + restored(token, True)
            if _WIDER.search(token):
                # A word cut once among others.
                for pair in zip(parts, parts[1:]):
                    joined = "-".join(pair)
                    found = found + (self.restored if len(joined) <= _LONG else self._restored)(joined)
        if len(parts) > 1:
            for part in parts:
                if len(part) > 2 and _SUSPECT.search(part):
                    found = found + self._readings(part)
        return [word for text in found for word in text.split()]

    def words(self, text: str) -> list[str]:
        """Restored forms of all suspect tokens of a lower-cased text."""
        out = []
        tokens = _TOKEN.findall(text)
        # Each token is judged once and kept; most have no readings, and these are passed over without a step of their own.
        if len(self.known) >= _CACHED:
            self.known.clear()
        known, long = self.known, {}
        for token in set(tokens).difference(known):
            found = self._readings(token) if len(token) > 2 and _SUSPECT.search(token) else []
            (known if len(token) <= _LONG else long)[token] = found
        look = known.get if not long else lambda token: long.get(token) or known.get(token)
        for found in filter(None, map(look, tokens)):
            out += found
        for hit in _SPACED.finditer(text):
            out += self._readings(hit.group())
        return out


_DECODERS: dict[bytes, Decoder] = {}


def _decoder(model: np.ndarray) -> Decoder:
    """The decoder of a model. A worker that runs several tasks keeps what it has read: no reading depends on a task."""
    key = model.tobytes()
    if key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = Decoder(model)
    return _DECODERS[key]


# --- words -----------------------------------------------------------------------------


def _word_sets(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[tuple[np.ndarray, int]]:
    """Distinct word hashes of each text, restored words included, and how many were restored."""
    found, bounds = word_hashes(*text_bytes(batch.column("text")), gaps=NOT_LETTERS)
    for row, text in enumerate(batch.column("text")):
        restored = decoder.words((text.as_py() or "").lower())
        own = found[bounds[row] : bounds[row + 1]]
        if restored:
            own = np.concatenate([own, hashed([w for w in restored if w], NOT_LETTERS)])
        yield np.unique(own), len(restored)


def _labelled_words(model: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 23):
                marks = batch.column("toxic").to_pylist()
                sets = [w for part in slices(batch.select(["text"]), "text") for w, _ in _word_sets(part, decoder)]
                words, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
                mark = np.repeat(np.array(marks, np.int64), [len(w) for w in sets])
                bad = np.bincount(place, mark, len(words)).astype(np.int64)
                every = np.bincount(place, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bad), pa.array(every)], ["word", "bad", "n"])

    return count


def lexicon(named: DataFrame, marks: DataFrame, model: np.ndarray) -> DataFrame:
    """(word hash, weight, gain) of all words that speak for label 1, from all labelled rows: texts (id, text), marks (id, toxic).

    Equal texts with equal labels count once, so that a group of copies does not make its words telling. One id stands for
    each of them; found among hashes, so that whole texts are shuffled once only, and by the same plan at every size.
    """
    marked = named.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    chosen = marked.select("id", "mark").join(marks, "id").groupBy("mark", "toxic").agg(F.min("id").alias("id"))
    chosen = staged(chosen, "labelled")
    totals = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    bad_docs, docs = int(totals[0]), int(totals[1])
    if not bad_docs or bad_docs == docs:
        return named.sparkSession.createDataFrame([], "word long, weight double, gain double")
    found = marked.join(chosen.hint("shuffle_hash"), ["id", "mark"])
    once = found.groupBy("id", "mark", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    counts = once.mapInArrow(_labelled_words(model), "word long, bad long, n long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n")
    )
    share, clean = bad_docs / docs, F.col("n") - F.col("bad")
    weight = F.ln((F.col("bad") + 0.5) / (bad_docs + 1)) - F.ln((clean + 0.5) / (docs - bad_docs + 1))
    part = lambda seen, hoped: F.when(seen > 0, seen * F.ln(seen / hoped)).otherwise(F.lit(0.0))
    gain = 2 * (part(F.col("bad"), F.col("n") * share) + part(clean, F.col("n") * (1 - share)))
    telling = counts.withColumn("weight", weight).withColumn("gain", gain).filter("weight > 1 and gain > 15 and bad >= 3")
    return staged(telling.select("word", "weight", "gain"), "lexicon")


def _slots(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each word in the filter."""
    place = words >> np.uint64(64 - FILTER_BITS)
    return (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, some = np.zeros(1 << (FILTER_BITS - 3), np.uint8), False
    for batch in batches:
        at, bit = _slots(batch.column("word").to_numpy().view(np.uint64))
        np.bitwise_or.at(bits, at, bit)
        some |= len(at) > 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


@dataclass
class Lexicon:
    """The nearest words with weights, sorted, and the filter of the rest."""

    words: np.ndarray
    weights: np.ndarray
    bits: np.ndarray


def split_lexicon(telling: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The ``NEAR_WORDS`` most telling words, and the table of all others."""
    near = telling.orderBy(F.desc("gain"), "word").limit(NEAR_WORDS).collect()
    rest = telling.filter(F.lit(False))
    if near:
        gain, word = near[-1]["gain"], near[-1]["word"]
        rest = telling.filter((F.col("gain") < gain) | ((F.col("gain") == gain) & (F.col("word") > word)))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rest.select("word").mapInArrow(_filters, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    order = sorted((np.int64(r["word"]).astype(np.uint64), r["weight"]) for r in near)
    words, weights = np.array([w for w, _ in order], np.uint64), np.array([v for _, v in order], np.float64)
    return Lexicon(words, weights, bits), rest.select("word", "weight")


# --- score -----------------------------------------------------------------------------


def _described(model: np.ndarray, known: Lexicon):
    """In place of each text the greatest and the sum of its near words' weights, and the words to ask for."""
    words, weights = known.words, known.weights

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                most, total, asks = [], [], []
                for own, _ in _word_sets(batch, decoder):
                    at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
                    hit = words[at] == own if len(words) else np.zeros(len(own), bool)
                    most.append(float(weights[at[hit]].max(initial=0.0)))
                    total.append(float(weights[at[hit]].sum()))
                    byte, bit = _slots(own)
                    asks.append(own[~hit & (known.bits[byte] & bit > 0)].view(np.int64))
                keep = [n for n in batch.schema.names if n != "text"]
                extra = [pa.array(most, pa.float64()), pa.array(total, pa.float64()), pa.array(asks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *extra], [*keep, "most", "total", "asks"])

    return describe


def _weighed(texts: DataFrame, model: np.ndarray, known: Lexicon, rest: DataFrame) -> DataFrame:
    """Rows of (id, text, toxic) as (id, toxic, most, all): greatest weight, logarithm of the sum of weights."""
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "id", "toxic", "text")
    found = rows.mapInArrow(_described(model, known), "row long, id long, toxic long, most double, total double, asks array<bigint>")
    asked = found.select("row", "id", "toxic", "most", "total", F.explode_outer("asks").alias("asked"))
    # Texts that ask for nothing are spread by their number.
    asked = asked.withColumn("word", F.coalesce("asked", F.xxhash64("row"))).join(rest, "word", "left")
    weight = F.when(F.col("asked").isNotNull(), F.coalesce("weight", F.lit(0.0))).otherwise(F.lit(0.0))
    sums = asked.withColumn("weight", weight).groupBy("row", "id", "toxic").agg(
        F.greatest(F.max("most"), F.max("weight")).alias("most"), F.log1p(F.max("total") + F.sum("weight")).alias("all")
    )
    return sums.select("id", "toxic", "most", "all")


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; without both labels the prior decides."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    if not len(y) or y.min() == y.max():
        w[2] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -4.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 0.1 * w * [1, 1, 0]
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 0.1, 1e-6])
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Key, ``held_out``, ``score`` in 0..1 and ``predicted`` of every row.

    ``learnable`` says on ``id`` which rows' labels may be learned from; label, language, source and id are never inputs of a
    score. Null and empty texts have no words. Several labels of one id count as 1 if any is; null ids and
    labels teach nothing. Rows are not merged. Without labels of both kinds the score is the share of ones.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    model = character_model(named)
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max((F.col(label) > 0).cast("long")).alias("toxic")
    )
    known, rest = split_lexicon(lexicon(named.filter(learnable), marks, model))
    chosen = marks.filter(learnable).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = named.join(F.broadcast(chosen), "id").select("id", "text", "toxic")  # fit_rows pairs of numbers at most
    rows = _weighed(sample, model, known, rest).collect()
    fitted = _logistic(np.array([(r["most"], r["all"]) for r in rows]).reshape(-1, 2), np.array([r["toxic"] for r in rows], np.float64))
    most, every, bias = (float(w) for w in fitted)
    out = _weighed(named.withColumn("toxic", F.lit(None).cast("long")), model, known, rest).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("most") * most + F.col("all") * every + bias)))
    )
    return out.select(
        F.col("id").alias(key), F.coalesce(~learnable, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
