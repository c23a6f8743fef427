"""Word bigram language model with Katz backoff.

Counts are Good-Turing discounted; what a context's discounts leave goes to the words not seen after it, in
proportion to their unigram probability, so that each context's probabilities sum to one. A word's own
probability backs off the same way: what its discounts leave belongs to one unseen type. Where discounts leave
nothing, or less than half a count, half a count is set aside.

Words and word pairs are counted over all training texts and dealt by key; every word is a context and
is predicted from one. The figures of the words counted most often, at most ``FREQUENT``, go to every task; this saves
look-ups and changes no result. A pair's score is kept as what it adds to
its context's backoff weight and its word's own probability, so that words, contexts and pairs are
looked up apart, and what comes back is added up per text.

Pairs of two frequent words are numbers, and most of all pairs. Each run of texts deals its pairs out once, sorted and
packed; they are stored beside all others of their bucket, counted there, and, once every context's figures are known,
counted again and answered. All other pairs are counted into a table, and each text's look-ups are dealt out by
key and answered beside it. A rare context's pairs all lie beside its count, and its backoff weight is worked out there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.tokens import mixed, slices, text_bytes, word_hashes
from skysift.session import staged

FREQUENT = 500_000
#: Steps of a class of counts, in powers of two, by which the frequent words are told.
CLASSES = 16
#: Counts up to this are discounted; every pair is stored, those seen once too.
DISCOUNTED = 5
LEAST_PAIR = 1
# Of a run of texts; and, by twos, of a bucket of packed pairs. A bucket of look-ups comes with the table rows they meet, in
# a task's memory at once, and holds a quarter as many.
FLUSH_TOKENS = 500_000
BUCKET_TOKENS = 1_000_000
# The end token: no word has this hash but by a chance of 2 ** -64.
END = np.uint64(0xE0D)
# Keys: 0 the start of a text, from 1 frequent words, below 0 the hashes of all others.
_RARE = np.uint64(1 << 63)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Runs of texts of about ``FLUSH_TOKENS`` tokens: other columns, token hashes with ends, bounds."""
    held, tokens = [], 0
    for whole in batches:
        for batch in slices(whole, "text"):
            words, bounds = word_hashes(*text_bytes(batch.column("text")))
            stream = np.insert(words, bounds[1:], END)
            held.append(([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], stream, np.diff(bounds) + 1))
            tokens += len(stream)
            if tokens >= FLUSH_TOKENS:
                yield _joined(held)
                tokens = 0
    if held:
        yield _joined(held)


def _joined(held):
    """One run of what was held, which is let go of."""
    others = [np.concatenate(c) for c in zip(*(h[0] for h in held))]
    out = others, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
    held.clear()
    _let_go()
    return out


def _let_go() -> None:
    """Workers live on from task to task: what Arrow holds in reserve is given back."""
    pa.default_memory_pool().release_unused()


# Each run and bucket is worked on in a function of its own, so that nothing of it is still held while the next one is read.
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(stream: np.ndarray) -> pa.RecordBatch:
        words, counts = np.unique(stream, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for _, stream, _ in _groups(batches, []):
        yield counted(stream)


@dataclass
class Kept:
    """Figures of the frequent words, by sorted hash; number 0 as a context is the start of a text."""

    words: np.ndarray
    counts: np.ndarray
    base: np.ndarray
    own: np.ndarray
    after: np.ndarray | None = None
    scale: np.ndarray | None = None

    def bare(self) -> Kept:
        """The words alone, for tasks that only number them."""
        none = np.zeros(0)
        return Kept(self.words, none, none, none)

    def figures(self) -> Kept:
        """All but what only those need that number the words or ask."""
        return replace(self, words=np.zeros(0), base=np.zeros(0))

    def asking(self) -> Kept:
        """All but what only those need that answer."""
        return replace(self, counts=np.zeros(0), scale=None)

    @property
    def size(self) -> int:
        return max(len(self.words), len(self.own))

    def times(self, starts: int) -> np.ndarray:
        """Tokens that follow each context; the first are those after the start of a text."""
        return np.concatenate([[float(starts)], self.counts])

    def keys(self, stream: np.ndarray) -> np.ndarray:
        """From 1 for frequent words, below 0 for others."""
        rare = (stream | _RARE).view(np.int64)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, stream), len(self.words) - 1)
        return np.where(self.words[at] == stream, at + 1, rare)

    def pair_keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a context's and a word's key: from 0 if both are frequent, else a hash below 0."""
        odd = (mixed(mixed(a.view(np.uint64)) + b.view(np.uint64)) | _RARE).view(np.int64)
        return np.where((a >= 0) & (b >= 0), a * (self.size + 1) + b, odd)


def _contexts(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Key of the token before each; 0 at the start of a text."""
    before = np.roll(keys, 1)
    starts = np.cumsum(lengths) - lengths
    before[starts[starts < len(before)]] = 0
    return before


def _keyed(kept: Kept):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = kept.keys(batch.column("word").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("n")], ["key", "n"])

    return key


def _rare_pair_counts(kept: Kept):
    """Counts of the pairs that hold a rare word."""

    def counted(stream: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        b = kept.keys(stream)
        a = _contexts(b, lengths)
        outside = (a < 0) | (b < 0)
        a, b = a[outside], b[outside]
        _, first, counts = np.unique(kept.pair_keys(a, b), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(counts)], ["a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream, lengths in _groups(batches, []):
            yield counted(stream, lengths)

    return count


def discounts(counts_of_counts: dict[int, int], least: int = 1) -> dict[int, float]:
    """Katz's factors for counts from 1 to ``DISCOUNTED``; 1 for larger ones.

    Where the counts of counts do not allow the formula (too few data), an absolute discount of a half is used.
    """
    n = lambda r: counts_of_counts.get(r, 0)
    k, out = DISCOUNTED, {}
    common = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    for r in range(1, k + 1):
        ratio = (r + 1) * n(r + 1) / (r * n(r)) if n(r) else 0.0
        factor = (ratio - common) / (1 - common) if common < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else 1 - 0.5 / r
    return out


def _shared(seen, times):
    """What is left for the unseen, and the factor that brings the seen to the rest."""
    left = np.maximum(1 - seen, 0.5 / (times + 1))
    return left, (1 - left) / seen


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _run(ids: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> int:
    """Names a run of texts by its first row and its content: were it cut otherwise when read again, no run would have that name."""
    figures = np.array([ids[0], len(ids), len(stream)], np.uint64)
    with np.errstate(over="ignore"):
        content = (stream.sum(dtype=np.uint64) + (lengths.astype(np.uint64) * mixed(ids.view(np.uint64))).sum(dtype=np.uint64)).reshape(1)
    return int(mixed(np.bitwise_xor.reduce(mixed(np.concatenate([figures, content]) + np.arange(4, dtype=np.uint64))).reshape(1)).view(np.int64)[0])


def _places(learn: np.ndarray) -> np.ndarray:
    """Numbers of a run's texts, those learned from first."""
    order = np.argsort(~learn.astype(bool), kind="stable")
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places


_DEALT = "bucket int, flush long, asks long, learners long, pairs binary, places binary"
_CLASSES = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
_BUCKETS = (
    "bucket int, flush array<long>, asks array<long>, learners array<long>, pairs array<binary>, places array<binary>, a array<long>, "
    + ", ".join(f"{c} array<long>" for c in _CLASSES)
    + ", more array<long>, used array<double>"
)


def _frequent_pairs(kept: Kept, spread: np.ndarray, buckets: int):
    """Each run's pairs of frequent words, by bucket: sorted, with the places of their texts.

    A context's pairs share a bucket, but for contexts too large for that: theirs are spread by the word.
    """
    kind = np.min_scalar_type(buckets)

    def cut(ids: np.ndarray, learn: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        b = kept.keys(stream)
        a = _contexts(b, lengths)
        inside = (a >= 0) & (b >= 0)
        places = np.repeat(_places(learn).astype(np.int32), lengths)[inside]
        a, b = a[inside], b[inside]
        pairs = kept.pair_keys(a, b)
        bucket = ((a + b % spread[a]) % buckets).astype(kind)
        del a, b, inside
        order = np.argsort(pairs)
        bucket = bucket[order]
        by_bucket = np.argsort(bucket, kind="stable")
        order, bucket = order[by_bucket], bucket[by_bucket]
        del by_bucket
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        flush, learners = _run(ids, stream, lengths), int(learn.astype(bool).sum())
        for first, last in zip(heads, [*heads[1:], len(bucket)]):
            mine = order[first:last]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[first])], pa.int32()), pa.array([flush], pa.int64()), pa.array([len(mine)], pa.int64()),
                    pa.array([learners], pa.int64()), pa.array([_packed(np.diff(pairs[mine], prepend=0))], pa.binary()),
                    pa.array([_packed(places[mine])], pa.binary()),
                ],
                ["bucket", "flush", "asks", "learners", "pairs", "places"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, learn), stream, lengths in _groups(batches, ["row", "learn"]):
            yield from cut(ids, learn, stream, lengths)

    return deal


def _opened(row) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs and places of a bucket's runs; its pairs in texts to learn from, and their counts.

    A bucket is the most that a task holds at once: nothing here is copied that can be made in place.
    """
    pairs = [_unpacked(p, n) for p, n in zip(row.pairs, row.asks)]
    for p in pairs:
        np.cumsum(p, out=p)
    places = [_unpacked(p, n).astype(np.int32) for p, n in zip(row.places, row.asks)]  # of one run's texts
    learned = np.concatenate([p[at < n] for p, at, n in zip(pairs, places, row.learners)])
    learned.sort()
    heads = np.flatnonzero(np.append(True, learned[1:] != learned[:-1])[: len(learned)])
    return pairs, places, learned[heads], np.diff(heads, append=len(learned))


def _gathered(kept: Kept):
    """A bucket as one row, with what each of its contexts has: pairs by their count, tokens of larger counts, own probabilities."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        _let_go()
        names = ["flush", "asks", "learners", "pairs", "places"]
        row = {"bucket": frame["bucket"].iloc[0], **{c: frame[c].to_numpy() for c in names}}
        _, _, keys, n = _opened(pd.Series(row))
        a, b = np.divmod(keys, kept.size + 1)
        contexts, first = np.unique(a, return_index=True)
        sums = lambda values: np.add.reduceat(values, first) if len(first) else values
        row["a"] = contexts
        row |= {c: sums((n == r).astype(np.int64)) for r, c in enumerate(_CLASSES, 1)}
        row["more"], row["used"] = sums(np.where(n > len(_CLASSES), n, 0)), sums(10 ** kept.own[b - 1])
        return pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in row.items()}).astype({"bucket": np.int32})

    return gather


def _counted_pairs(kept: Kept):
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                _, _, keys, n = _opened(row)
                a, b = np.divmod(keys, len(kept.words) + 1)
                yield pd.DataFrame({"a": a, "b": b, "n": n, "m": np.zeros(len(n), np.int64)})

    return counted


def _answered_frequent(model: Model):
    """What each run's texts get from a bucket's pairs."""
    kept = model.kept.figures()
    plain = replace(model, rows=None, words=None, rare_pairs=None, buckets=None, kept=kept)

    def answered(row) -> pd.DataFrame:
        pairs, places, keys, n = _opened(row)
        a, b = np.divmod(keys, kept.size + 1)
        held, own = plain.pair_figures(b, n, np.zeros(len(n)))
        score = np.log10(kept.scale[a] * held / kept.times(plain.starts)[a]) - kept.after[a] - own
        del a, b, n, held, own
        out = []
        for flush, asked, at in zip(row.flush, pairs, places):
            used, texts = np.unique(at, return_inverse=True)
            none = np.zeros(0)
            sums = np.bincount(texts, _looked_up(asked, keys, score), len(used))
            out.append((flush, used, none, none, none, none, none, none, sums))
        return pd.DataFrame(out, columns=_PART_NAMES)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                _let_go()
                yield answered(row)

    return answer


def _counts_of_counts(table: DataFrame) -> dict[int, int]:
    return {r["n"]: r["types"] for r in table.filter(F.col("n") <= DISCOUNTED + 1).groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect()}


def _discounted(n: Column, factors: dict[int, float]) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for r, f in factors.items():
        out = out.when(n == r, F.lit(f))
    return n * out.otherwise(F.lit(1.0))


@dataclass
class Model:
    rows: DataFrame
    words: DataFrame
    rare_pairs: DataFrame
    buckets: DataFrame
    kept: Kept
    tokens: int
    types: int
    starts: int
    word_factors: dict[int, float]
    pair_factors: dict[int, float]
    unseen: float = 1.0
    scale: float = 1.0

    @property
    def pairs(self) -> DataFrame:
        """All pairs and their counts; ``m`` counts the word where it is rare."""
        frequent = self.buckets.select("flush", "asks", "learners", "pairs", "places")
        return self.rare_pairs.unionByName(frequent.mapInPandas(_counted_pairs(self.kept), "a long, b long, n long, m long"))

    def base(self, n: np.ndarray | float):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def own(self, n: np.ndarray) -> np.ndarray:
        """log10 of a word's own probability from its count."""
        factor = np.ones(len(n))
        for r, f in self.word_factors.items():
            factor[n == r] = f
        return np.log10(np.where(n > 0, self.scale * factor * n / max(self.tokens, 1), self.unseen))

    def pair_figures(self, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted counts of pairs, and log10 of their words' own probabilities; ``m`` counts a rare word."""
        factor = np.ones(len(n))
        for r, f in self.pair_factors.items():
            factor[n == r] = f
        own = self.own(m.astype(np.float64))
        own[b > 0] = self.kept.own[b[b > 0] - 1]
        return factor * n, own


def _most_counted(words: DataFrame, tokens: int, kept: int | None) -> Column:
    """Says which words are frequent: at most ``FREQUENT``, those counted most often, or with ``kept`` those that make up one in so many tokens."""
    if kept is not None:
        return F.col("n") * kept >= tokens
    step = F.floor(F.log2(F.col("n")) * CLASSES)
    found = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("types"), F.min("n").alias("least")).collect()
    least, held = None, 0
    for r in sorted(found, key=lambda r: -r["step"]):
        held += r["types"]
        if held > FREQUENT:
            break
        least = r["least"]
    return F.col("n") >= least if least is not None else F.lit(False)


def fit(texts: DataFrame, kept: int | None = None) -> Model:
    """Learn from the rows of (id, text, learn) whose ``learn`` is true."""
    # Rows are told apart by a number of their own: ids may be null or repeat.
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNotNull().alias("named"),
        "learn", "text",
    )
    known = texts.filter("learn").select("text", "learn")
    words = staged(known.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    end = F.col("word") == int(END.astype(np.int64))
    tokens, types, starts = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(end, F.col("n")))).first()
    tokens, types, starts = tokens or 0, types or 0, starts or 0
    factors = discounts(_counts_of_counts(words))
    model = Model(rows, None, None, None, None, tokens, types, starts, factors, {})
    mass = words.agg(F.sum(_discounted(F.col("n"), factors))).first()[0] or 0.0
    if tokens:
        model.unseen, model.scale = (float(x) for x in _shared(mass / tokens, tokens))
    found = words.filter(_most_counted(words, tokens, kept)).toArrow()
    hashes, counts = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.float64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    model.kept = Kept(hashes, counts, model.base(counts), model.own(counts))
    model.words = words.mapInArrow(_keyed(model.kept.bare()), "key long, n long").filter("key < 0")
    # Dealt once, for the counts and for the join: by the word where it is rare, else by a hash of both.
    by = F.when(F.col("b") < 0, F.col("b")).otherwise(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFF)))
    counted = known if kept is None else known.filter(F.lit(False))
    pairs = counted.mapInArrow(_rare_pair_counts(model.kept.bare()), "a long, b long, n long").withColumn("by", by)
    pairs = pairs.repartition("by").groupBy("by", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAIR)
    own = model.words.select(F.col("key").alias("by"), F.col("n").alias("m"))
    model.rare_pairs = staged(pairs.join(own, "by", "left").select("a", "b", "n", F.coalesce("m", F.lit(0)).alias("m")), "pairs")
    times = model.kept.times(starts)
    buckets = max(1, -(-tokens // (2 * BUCKET_TOKENS)))
    spread = np.clip(np.ceil(times * 2 / BUCKET_TOKENS), 1, buckets).astype(np.int32)
    dealt = rows.select("row", "learn", "text").mapInArrow(_frequent_pairs(model.kept.bare(), spread, buckets), _DEALT)
    model.buckets = staged(dealt.groupBy("bucket").applyInPandas(_gathered(model.kept.figures()), _BUCKETS), "buckets")
    # What each frequent context has, over all its pairs: at most as many rows as there are frequent words, and one for all others.
    figures = [*_CLASSES, "more", "used"]
    inside = model.buckets.select(F.inline(F.arrays_zip("a", *figures)))
    n, m = F.col("n"), F.col("m")
    outside = model.rare_pairs.groupBy(F.greatest("a", F.lit(-1)).alias("a")).agg(
        *[F.count_if(n == r).alias(c) for r, c in enumerate(_CLASSES, 1)],
        F.sum(F.when(n > len(_CLASSES), n).otherwise(F.lit(0))).alias("more"),
        F.sum(F.when(m > 0, _discounted(m, factors) * F.lit(model.scale) / F.lit(float(max(tokens, 1)))).otherwise(F.lit(0.0))).alias("used"),
    )
    # The pairs of frequent contexts and rare words: the word's own probability is used up too.
    held = inside.unionByName(outside).groupBy("a").agg(*[F.sum(c).alias(c) for c in figures]).toArrow()
    a, by_count = held["a"].to_numpy(), [held[c].to_numpy().astype(np.float64) for c in _CLASSES]
    model.pair_factors = discounts({r: int(found.sum()) for r, found in enumerate(by_count, 1)})
    mass = sum(r * model.pair_factors.get(r, 1.0) * found for r, found in enumerate(by_count, 1)) + held["more"].to_numpy()
    after, scale = np.zeros(len(times)), np.ones(len(times))
    here = a >= 0
    a, mass, used = a[here], mass[here], held["used"].to_numpy()[here]
    if len(a):
        left, scale[a] = _shared(mass / times[a], times[a])
        after[a] = np.log10(left / (1 - used))
    model.kept.after, model.kept.scale = after, scale
    return model


_ASKS = pa.schema(
    [("bucket", pa.int32()), ("flush", pa.int64())]
    + [
        (name, pa.list_(kind))
        for name, kind in (
            ("ids", pa.int64()), ("keys", pa.int64()), ("named", pa.bool_()), ("learn", pa.bool_()), ("tokens", pa.int64()),
            ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("words", pa.int64()), ("word_rows", pa.int32()),
            ("pairs", pa.int64()), ("pair_rows", pa.int32()),
        )
    ]
)
_KINDS = (
    "bucket int, flush long, ids array<bigint>, keys array<bigint>, named array<boolean>, learn array<boolean>,"
    " tokens array<bigint>, known array<bigint>, base array<double>, own array<double>, words array<bigint>,"
    " word_rows array<int>, pairs array<bigint>, pair_rows array<int>"
)
_PARTS = (
    "flush long, ids array<bigint>, keys array<bigint>, named array<boolean>, learn array<boolean>, tokens array<bigint>,"
    " known array<bigint>, base array<double>, score array<double>"
)
_PART_NAMES = ["flush", "ids", "keys", "named", "learn", "tokens", "known", "base", "score"]
_OUT = "key long, named boolean, learn boolean, n_tokens long, n_known long, base_score double, score double"


def _asked(kept: Kept, buckets: int, frequent_only: bool):
    def asked(turn: int, ids, keys, named, learn, stream: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        tokens = kept.keys(stream)
        before = _contexts(tokens, lengths)
        inside, after = tokens >= 0, before >= 0
        add = lambda mask, values: np.bincount(rows[mask], values, len(ids)).astype(np.float64)
        base = add(inside, kept.base[tokens[inside] - 1])
        own = add(inside, kept.own[tokens[inside] - 1]) + add(after, kept.after[before[after]])
        known = np.bincount(rows[inside], minlength=len(ids))
        words, word_rows = tokens[~inside], rows[~inside]
        both = np.zeros(len(tokens), bool) if frequent_only else ~(after & inside)
        first_keys, second_keys, pair_rows = before[both], tokens[both], rows[both]
        pairs = kept.pair_keys(first_keys, second_keys)
        word_bucket = _word_bucket(words, buckets)
        pair_bucket = _word_bucket(np.where(first_keys < 0, first_keys, second_keys), buckets)
        word_order, pair_order = np.lexsort((words, word_bucket)), np.lexsort((pairs, pair_bucket))
        word_cuts = np.searchsorted(word_bucket[word_order], np.arange(buckets + 1))
        pair_cuts = np.searchsorted(pair_bucket[pair_order], np.arange(buckets + 1))
        first, flush = turn % buckets, _run(ids, stream, lengths)
        for b in range(buckets):
            w, p = word_order[word_cuts[b] : word_cuts[b + 1]], pair_order[pair_cuts[b] : pair_cuts[b + 1]]
            # Only the texts this bucket is asked for.
            used = np.arange(len(ids)) if b == first else np.unique(np.concatenate([word_rows[w], pair_rows[p]]))
            if not len(used):
                continue
            sums = [keys, named, learn, lengths, known, base, own] if b == first else [np.zeros(0)] * 7
            place = np.zeros(len(ids), np.int32)
            place[used] = np.arange(len(used), dtype=np.int32)
            values = [ids[used], *sums, words[w], place[word_rows[w]], pairs[p], place[pair_rows[p]]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int32()),
                    pa.array([flush], pa.int64()),
                    *(
                        pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(f.type.value_type.to_pandas_dtype())))
                        for v, f in zip(values, list(_ASKS)[2:])
                    ),
                ],
                schema=_ASKS,
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (columns, stream, lengths) in enumerate(_groups(batches, ["row", "key", "named", "learn"])):
            yield from asked(turn, *columns, stream, lengths)

    return ask


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _look_up_buckets(rare_tokens: int) -> int:
    """A rare word is looked up itself, and in at most two pairs; a table has as many rows at most."""
    return max(1, -(-8 * rare_tokens // BUCKET_TOKENS))


def _answered(model: Model):
    kept = model.kept.figures()
    plain = replace(model, rows=None, words=None, rare_pairs=None, buckets=None, kept=kept)

    def answer(asks: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        _let_go()
        words = table[table["kind"] == 0].sort_values("a")
        word_keys, word_n = words["a"].to_numpy(np.int64), words["n"].to_numpy(np.float64)
        a, b, n, m = (table.loc[table["kind"] == 1, c].to_numpy(np.int64) for c in ("a", "b", "n", "m"))
        held, own = plain.pair_figures(b, n, m)
        # A rare context's pairs are all here, and so is its count.
        rare, word_after, word_scale = a < 0, np.zeros(len(word_keys)), np.ones(len(word_keys))
        at = np.searchsorted(word_keys, a[rare])
        seen = np.bincount(at, held[rare], len(word_keys))
        has = seen > 0
        left, word_scale[has] = _shared(seen[has] / word_n[has], word_n[has])
        word_after[has] = np.log10(left / (1 - np.bincount(at, 10 ** own[rare], len(word_keys))[has]))
        place, times = np.maximum(a, 0), kept.times(plain.starts)
        after, scale, times = kept.after[place], kept.scale[place], times[place]
        after[rare], scale[rare], times[rare] = word_after[at], word_scale[at], word_n[at]
        pair_keys, pair_score = kept.pair_keys(a, b), np.log10(scale * held / times) - after - own
        order = np.argsort(pair_keys)
        pair_keys, pair_score = pair_keys[order], pair_score[order]
        out = []
        for row in asks.itertuples(index=False):
            n = len(row.ids)
            known, base, score = (np.array(v, np.float64) if len(row.tokens) else np.zeros(n) for v in (row.known, row.base, row.own))
            asked, rows = np.asarray(row.words, np.int64), np.asarray(row.word_rows, np.int64)
            found = _looked_up(asked, word_keys, word_n)
            known += 1.0 * np.bincount(rows, found > 0, n)
            base += 1.0 * np.bincount(rows, plain.base(found), n)
            score += 1.0 * np.bincount(rows, plain.own(found) + _looked_up(asked, word_keys, word_after), n)
            asked, rows = np.asarray(row.pairs, np.int64), np.asarray(row.pair_rows, np.int64)
            score += 1.0 * np.bincount(rows, _looked_up(asked, pair_keys, pair_score), n)
            out.append((row.flush, row.ids, row.keys, row.named, row.learn, row.tokens, known.astype(np.int64), base, score))
        return pd.DataFrame(out, columns=_PART_NAMES)

    return answer


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    """All texts of one run: the part with its own figures names them, the others add to it."""
    _let_go()
    own = next((row for row in parts.itertuples(index=False) if len(row.tokens)), None)
    if own is None:
        raise RuntimeError("the texts were dealt otherwise when they were read again")
    known, base, score = (np.zeros(len(own.ids)) for _ in range(3))
    placed = np.argsort(_places(np.asarray(own.learn, bool)))
    for row in parts.itertuples(index=False):
        if not len(row.known):  # pairs of frequent words: by the places of their texts
            score[placed[row.ids]] += row.score
            continue
        at = np.searchsorted(own.ids, row.ids)
        known[at] += row.known
        base[at] += row.base
        score[at] += row.score
    return pd.DataFrame({
        "key": own.keys, "named": own.named, "learn": own.learn, "n_tokens": own.tokens, "n_known": known.astype(np.int64),
        "base_score": base, "score": score,
    })


def _looked_up(asked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(asked))
    if len(keys) and len(asked):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        same = keys[at] == asked
        out[same] = values[at[same]]
    return out


def scored(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", kept: int | None = None) -> DataFrame:
    """Per document: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learnable`` says on ``id`` which rows the model learns from; rows for which it is null are held out.
    A null or empty text is its end token alone. Rows that share an id are scored each by itself. An empty table gives no
    rows; with nothing to learn from every token is unseen. Other columns are not read.
    With ``kept`` the caller asks for a smaller model, of pairs of words that each make up one in ``kept`` of the tokens.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("learn", F.coalesce(learnable, F.lit(False)))
    model = fit(texts, kept)
    buckets = _look_up_buckets(model.tokens - int(model.kept.counts.sum()))
    asks = model.rows.mapInArrow(_asked(model.kept.asking(), buckets, kept is not None), _KINDS)
    word_bucket = lambda key: F.shiftrightunsigned(key, 32) % buckets
    rare = model.words.select(
        word_bucket("key").cast("int").alias("bucket"), F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(0).cast("long").alias("b"),
        "n", F.lit(0).cast("long").alias("m"),
    )
    pair_bucket = F.when(F.col("a") < 0, word_bucket("a")).otherwise(word_bucket("b"))
    pairs = model.rare_pairs.select(pair_bucket.cast("int").alias("bucket"), F.lit(1).alias("kind"), "a", "b", "n", "m")
    parts = asks.groupBy("bucket").cogroup(rare.unionByName(pairs).groupBy("bucket")).applyInPandas(_answered(model), _PARTS)
    frequent = model.buckets.select("flush", "asks", "learners", "pairs", "places")
    parts = parts.unionByName(frequent.mapInPandas(_answered_frequent(model), _PARTS))
    return parts.groupBy("flush").applyInPandas(_summed, _OUT).select(
        F.when(F.col("named"), F.col("key")).alias(key), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
