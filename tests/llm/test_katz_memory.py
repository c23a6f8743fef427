"""What a task of the language model holds at once."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

from skysift.llm import katz
from skysift.llm.tokens import hashed

WORDS = 20_000


def model():
    rng = np.random.default_rng(5)
    own = np.log10(rng.random(WORDS) / WORDS)
    kept = katz.Kept(np.arange(WORDS, dtype=np.uint64), np.full(WORDS, 1e4), np.zeros(WORDS), own, np.zeros(WORDS + 1), np.ones(WORDS + 1))
    factors = katz.discounts({1: 9, 2: 5, 3: 3})
    return katz.Model(None, None, None, None, kept, 10**8, 10**6, 10**5, factors, factors)


def bucket(runs, asks):
    """A bucket as one row, of contexts 1 to 9; half of each run's texts are learned from."""
    rng = np.random.default_rng(6)
    pairs = [np.sort(rng.integers(1, 10, asks) * (WORDS + 1) + rng.integers(1, WORDS + 1, asks)) for _ in range(runs)]
    places = [rng.integers(0, 1_000, asks) for _ in range(runs)]
    row = {
        "flush": np.arange(runs), "asks": np.full(runs, asks), "learners": np.full(runs, 500),
        "pairs": [katz._packed(np.diff(p, prepend=0)) for p in pairs], "places": [katz._packed(p) for p in places],
    }
    return pairs, places, pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in row.items()})


def test_a_bucket_opens_as_it_was_packed():
    pairs, places, frame = bucket(3, 400)
    opened, at, keys, n = katz._opened(frame.iloc[0])
    assert all(np.array_equal(x, y) for x, y in zip([*opened, *at], [*pairs, *places]))
    learned = np.concatenate([p[q < 500] for p, q in zip(pairs, places)])
    want, counts = np.unique(learned, return_counts=True)
    assert np.array_equal(keys, want) and np.array_equal(n, counts)
    nothing = frame.assign(learners=pd.Series([np.zeros(3, np.int64)], dtype=object))
    assert [len(x) for x in katz._opened(nothing.iloc[0])[2:]] == [0, 0]


def test_answering_a_bucket_holds_few_copies():
    """Pairs take 8 bytes each, their places 4, those learned from 8 at most."""
    _, _, frame = bucket(20, 50_000)
    answer = katz._answered_frequent(model())
    tracemalloc.start()
    try:
        list(answer(iter([frame])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 26 * 1_000_000


def test_answering_tasks_get_only_what_they_read():
    for answer in (katz._answered_frequent(model()), katz._answered(model())):
        assert len(cloudpickle.dumps(answer)) < 4.5 * 8 * WORDS  # of six figures a word


def test_a_run_is_let_go_before_the_next(monkeypatch):
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 200_000)
    text = pa.array([" ".join(f"w{i * j % 997}" for i in range(1_000)) for j in range(1_000)])
    rows = pa.array(np.arange(1_000))
    batch = pa.RecordBatch.from_arrays([rows, pa.array(np.ones(1_000, bool)), text], ["row", "learn", "text"])
    deal = katz._frequent_pairs(katz.Kept(np.sort(hashed([f"w{i}" for i in range(997)])), *[np.zeros(0)] * 3), np.ones(998, np.int32), 4)
    tracemalloc.start()
    try:
        asks = sum(dealt.column("asks")[0].as_py() for dealt in deal(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert asks == 1_000_000  # all words are frequent
    assert most < 60_000_000


def test_buckets_of_look_ups_are_small():
    """Look-ups and the table's rows they meet lie in a task's memory at once: six for each rare token at most."""
    for rare in (0, 1, 735_033, 4_881_675):
        assert 6 * rare / katz._look_up_buckets(rare) <= 0.75 * katz.BUCKET_TOKENS
