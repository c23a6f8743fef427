"""Clashing columns, rows without ids, texts full of hits, licences against an exhaustive search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from skysift.llm import katz, license_scan, mixing, packing


def test_added_columns_give_way_to_those_of_documents(spark):
    docs = spark.createDataFrame([(i, "text", "s", "a", "b") for i in range(20)], "doc_id long, text string, source string, Copy string, place string")
    out = mixing.flat(mixing.mixed(docs, mixing.repetition_rates(docs)))
    assert out.columns == ["doc_id", "text", "source", "Copy", "place", "copy_", "place_"]
    assert {(r.Copy, r.place) for r in out.collect()} == {("a", "b")}


def test_rows_without_ids_draw_each_for_themselves(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(400)], "doc_id long, text string, source string")
    out = mixing.mixed(docs, mixing.repetition_rates(docs)).groupBy("row.text").count().collect()
    assert 200 < len(out) < 300 and len({r["count"] for r in out}) > 2


def test_equal_rows_without_ids_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "a few words", "s")] * 3_000, "doc_id long, text string, source string")
    bins = [r.bin_id for r in packing.packed(docs, shard_items=500).collect()]
    assert len(set(bins)) == 3_000
    shards = [b >> 32 for b in bins]
    assert len(set(shards)) == 6 and max(shards.count(s) for s in set(shards)) < 700


def test_a_text_full_of_notices_is_scanned_in_one_go(spark, documents):
    times = []
    for n in (2_000, 16_000):
        text, began = "mit licence apache license " * n, time.time()
        (row,) = license_scan.notices(documents([(1, text)])).collect()
        times.append(time.time() - began)
        assert row.n_base == n and len(row.spans) == 2 * n
        assert [s.first_word for s in row.spans] == list(range(0, 4 * n, 2))
    assert times[1] < 24 * times[0] + 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_edits(words, phrase, bound):
    """The smallest edit distance of a run of whole words to the phrase, if it is within the bound."""
    found = [
        d
        for i in range(len(words))
        for j in range(i + 1, len(words) + 1)
        if abs(len(" ".join(words[i:j])) - len(phrase)) <= bound and (d := edits(" ".join(words[i:j]), phrase)) <= bound
    ]
    return min(found, default=None)


def altered(rng, phrase):
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(phrase))
        phrase = phrase[:at] + rng.choice(["", "x", "e", " "]) + phrase[at + rng.randrange(2) :]
    return phrase


def test_labels_and_edits_equal_an_exhaustive_search(documents):
    rng = random.Random(9)
    phrases = dict(license_scan.PHRASES)
    texts = []
    for _ in range(150):
        parts = [altered(rng, rng.choice([*phrases, "some other words", "license"])) for _ in range(rng.randrange(1, 4))]
        texts.append(" filler ".join(parts))
    got = {r.doc_id: r for r in license_scan.notices(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = text.lower().split()
        found = {p: least_edits(words, p, len(p) // license_scan.CHARS_PER_ERROR) for p in phrases}
        wanted = {p: d for p, d in found.items() if d is not None}
        assert got[i].labels == ",".join(sorted(phrases[p] for p in wanted)), text
        best = max((1 - d / len(p) for p, d in wanted.items()), default=0.0)
        assert got[i].score == pytest.approx(best), text


@pytest.mark.parametrize("share", [0.0, 0.6])
def test_katz_leaves_out_pairs_seen_once_only_after_counting_them(spark, share):
    """Counts of counts, taken along with the write, equal a plain count; also where one pair makes up most tokens."""
    rng = random.Random(1)
    texts = [" ".join("hot pair" if rng.random() < share else f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id long, text string, learn boolean")
    model = katz.fit(rows)
    counts = {}
    for text in texts:
        words = [None, *text.split(), "<end>"]
        for pair in zip(words[:-1], words[1:]):
            counts[pair] = counts.get(pair, 0) + 1
    of_counts = {n: list(counts.values()).count(n) for n in range(1, katz.DISCOUNTED + 2)}
    assert model.pair_factors == katz.discounts(of_counts)
    assert sorted(r.n for r in model.pairs.collect()) == sorted(n for n in counts.values() if n >= katz.LEAST_PAIR)


def test_katz_of_nothing(spark, documents):
    assert katz.scored(documents([]), F.lit(True)).count() == 0
    (row,) = katz.scored(documents([(1, "a b")]), F.lit(False)).collect()
    assert row.train_tokens == 0 and row.n_known == 0
