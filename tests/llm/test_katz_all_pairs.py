import random

import pytest
from pyspark.sql import functions as F

from skysift.llm import katz
from tests.llm.test_other_operators import plain_katz

EVERY = 10**9


@pytest.mark.parametrize("frequent", [1, 60, 500_000])
def test_rare_words_are_contexts_and_predicted(documents, monkeypatch, frequent):
    """The share of words that go to every task changes no score: the twin uses all pairs."""
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 500)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 1_000)
    draw = random.Random(11)
    words = [f"W{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(300)], k=draw.randrange(0, 60)))) for i in range(200)]
    rows += [(300 + i, "rare pair rare pair") for i in range(3)] + [(900, None), (901, "fresh words only"), (902, "w1 rare pair w2")]
    learn = lambda k: k % 5 != 1
    want = plain_katz(rows, learn, EVERY)
    got = katz.scored(documents(rows), F.col("id") % 5 != 1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


def test_no_least_count_that_rises_with_the_input(documents):
    """Over 500,000 tokens a pair of words seen twice still counts."""
    rows = [(0, "a b " * 300_000), (5, "rare pair"), (10, "rare pair"), (15, "c " * 300_000), (1, "rare pair"), (6, "a pair")]
    want = plain_katz(rows, lambda k: k % 5 != 1, EVERY)
    # Sums of 600,000 logarithms round in the fifth place.
    for r in katz.scored(documents(rows), F.col("id") % 5 != 1).collect():
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], abs=1e-4)


def test_pairs_seen_once_are_of_the_model(documents):
    """A pair seen once scores by its discounted count, not by backing off."""
    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(90)}" for _ in range(draw.randrange(1, 30)))) for i in range(120)]
    rows += [(500, "only once"), (501, "only once"), (506, "once only")]
    learn = lambda k: k % 5 != 1
    want = plain_katz(rows, learn, EVERY)
    texts = documents(rows)
    got = {r.doc_id: r for r in katz.scored(texts, F.col("id") % 5 != 1).collect()}
    assert len(got) == len(rows)
    for key, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[key][:3]
        assert (r.base_score, r.score) == pytest.approx(want[key][3:])
    assert got[501].score > got[506].score + 1
    known = texts.selectExpr("doc_id AS id", "text", "doc_id % 5 <> 1 AS learn")
    assert katz.fit(known).pairs.filter("n = 1").count() > 100


def test_pairs_of_frequent_words_travel_packed(documents, monkeypatch):
    """One row for each run and bucket, none for each pair; the words counted most often are frequent, however small their share."""
    monkeypatch.setattr(katz, "FREQUENT", 50)
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 400)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 150)
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{int(draw.random() ** 3 * 400)}" for _ in range(draw.randrange(0, 40)))) for i in range(300)]
    texts = documents(rows)
    known = texts.selectExpr("doc_id AS id", "text", "doc_id % 5 <> 1 AS learn")
    model = katz.fit(known)
    assert 30 < len(model.kept.words) <= 50
    assert model.rare_pairs.filter("a >= 0 AND b >= 0").count() == 0
    assert 1 < model.buckets.count() < model.buckets.selectExpr("explode(flush)").count()
    assert model.pairs.filter("a >= 0 AND b >= 0").count() > 500
    want = plain_katz(rows, lambda k: k % 5 != 1, EVERY)
    for r in katz.scored(texts, F.col("id") % 5 != 1).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])
