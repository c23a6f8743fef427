import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import toxicity

BAD = ["idiot", "moron", "stupid", "worthless", "disgusting", "asshole", "ass", "trash", "loser"]
FORMS = [
    "worthle$$", "worthles5", "idio7", "disgustin9", "asshol3", "a55", "a$$", "@$$", "tras#", "(5tupid)", ",1diot", "stuupid", "loseer",
    "id-iot", "stu.pid", "idiot!!", "1D1OT.", "wor-thle$$", "dumb-1d1ot", "so_5tupid", "1d1ot.5tupid", "an-1d1ot", "id-iot-people",
    "i  d  i  o  t", "i--d--i--o--t", "i\nd\ni\no\nt", "t h e r e   i d i o t", "s t u p i d", "x-" * 40 + "1d1ot", "a " * 40 + "  m o r o n",
]
PLAIN = ["hello!", "(letter)", "summer2024", "well-known", "$100", "3rd", "good", "tomorrow...", "garden.people", "winter's", "class", "b2b", "well-known-class",
         "g o o d   p e o p l e", "a - b - c"]


@pytest.fixture(scope="module")
def predicted(spark):
    draw = random.Random(7)
    words = ["hello", "there", "people", "morning", "letter", "summer", "winter", "garden", "tomorrow", "evening", "good", "class", "known", "well", "third"]
    rows = [(i, " ".join(draw.choices(words, k=30) + ([draw.choice(BAD)] if i % 4 == 0 else []))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id long, toxic int")
    extra = [(1000 + i, f"hello there {form} garden") for i, form in enumerate(FORMS + PLAIN)]
    out = toxicity.scored(spark.createDataFrame(rows + extra, "doc_id long, text string"), labels, F.col("id") % 3 != 1)
    return {r.doc_id: r.predicted for r in out.collect()}


@pytest.mark.parametrize("form", FORMS + PLAIN)
def test_disguised_words_are_restored(predicted, form):
    assert predicted[1000 + (FORMS + PLAIN).index(form)] == int(form in FORMS)


# --- the search --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def decoder(spark):
    texts = spark.createDataFrame([("the idiot was a stupid person in the garden and so was the other one",)] * 50, "text string")
    return toxicity.Decoder(toxicity.character_model(texts))


def _all_paths(decoder, token, parted):
    """Score and text of every path through the lattice of a token, worked out one by one."""
    paths = [(0.0, toxicity._EDGE, toxicity._EDGE, "")]
    for options in decoder._options(token, parted):
        after = []
        for score, a, b, text in paths:
            for letter, cost in options:
                if not letter or letter == " " and b == toxicity._EDGE:
                    after.append((score + cost, a, b, text))
                else:
                    c = toxicity._EDGE if letter == " " else ord(letter) - 97
                    after.append((score + cost + decoder.model[a][b][c], b, c, text + letter))
        paths = after
    return [(s + (0.0 if b == toxicity._EDGE else decoder.model[a][b][toxicity._EDGE]), text) for s, a, b, text in paths if text]


@pytest.mark.parametrize("parted", [False, True])
def test_best_path_of_all_paths(decoder, parted):
    draw = random.Random(3)
    for _ in range(150):
        token = "".join(draw.choices("abidotsu1350$--..", k=draw.randint(3, 8)))
        if not toxicity._TOKEN.fullmatch(token):
            continue
        every = _all_paths(decoder, token, parted)
        best, least = max(s for s, _ in every), decoder._unchanged(token) - 3
        found = decoder.restored(token, parted)
        if found:
            assert max(s for s, text in every if text == found[0]) == pytest.approx(best)
        else:
            assert best <= least


def test_long_runs_are_read_whole(decoder):
    for size in (100, 5_000):
        assert "idiot" in decoder.words("s o   " * size + "i d i o t")
        assert "idiot" in decoder.words("so-" * size + "1d1ot")
    assert decoder.words("a" + "*" * 5_000 + "b") is not None


def test_tasks_of_a_worker_share_what_was_read():
    model = np.log(np.full((28, 28, 28), 1 / 28))
    first = toxicity._decoder(model)
    assert first.words("moooron") == toxicity.Decoder(model).words("moooron")
    assert toxicity._decoder(model.copy()) is first and "moooron" in first.known
    assert toxicity._decoder(model * 2) is not first
