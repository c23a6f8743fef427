import pytest
from pyspark.sql import functions as F

from skysift.llm import toxicity

# 3,000 words without doubled letters, each in three toxic texts.
WORDS = [a + "a" + b + "e" + c + "i" for a in "bcdfghjklmnpqrs" for b in "bcdfghjklmnpqrs" for c in "bcdfghjklmnpqrs"][:3_000]


@pytest.mark.parametrize("near", [100_000, 10])
def test_no_number_of_toxic_words_is_dropped(spark, monkeypatch, near):
    monkeypatch.setattr(toxicity, "NEAR_WORDS", near, raising=False)
    toxic = [" ".join(WORDS[30 * i : 30 * i + 30]) + f" {'xyz'[j]}o" for i in range(100) for j in range(3)]
    clean = ["".join("bcdfghjklm"[int(d)] + "u" for d in f"{i:04d}") for i in range(6_000)]
    rows = [(i, t) for i, t in enumerate(toxic + clean)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(len(rows))], "doc_id long, toxic int")
    rows += [(10_000 + i, word) for i, word in enumerate(WORDS)] + [(20_000, "huko")]
    out = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.col("id") < 10_000)
    got = {r.doc_id: r.score for r in out.collect()}
    assert len(got) == len(rows)
    assert max(got[10_000 + i] for i in range(3_000)) == pytest.approx(min(got[10_000 + i] for i in range(3_000)))
    assert got[10_000] > got[20_000] + 0.2
