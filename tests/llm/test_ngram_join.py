import random

import pytest

from skysift.llm import ngram_join
from skysift.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def plain(rows, k, percent):
    """Brute force: sets of shingles, all pairs, smallest id of each component."""
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    parent = {key: key for key in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {key: (len(s), root(key)) for key, s in sets.items()}


def families(seed=1):
    """Near copies at many sizes and distances, copies, a shared passage, short and empty texts."""
    draw, rows = random.Random(seed), []
    passage = " ".join(draw.choices(WORDS, k=60))
    for size in (3, 5, 8, 12, 20, 35, 60, 61, 64, 120, 130, 250, 520):
        base = draw.choices(WORDS, k=size)
        for change in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            text = list(base)
            for _ in range(change):
                text[draw.randrange(len(text))] = draw.choice(WORDS)
            rows.append(" ".join(text + draw.choices(WORDS, k=change % 3)))
        rows.append(passage + " " + " ".join(draw.choices(WORDS, k=size)))
    draw.shuffle(rows)
    return [(i * 7 + 3, t) for i, t in enumerate([*rows, "", "   ", None, "One", "one", " ONE "])]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(documents, k, percent):
    rows = families()
    got = ngram_join.jaccard_classes(documents(rows), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, k, percent)


def test_split_tiles_and_units_change_nothing(documents, monkeypatch):
    for name, value in (("TILE_ROWS", 4), ("UNIT_ROWS", 5), ("TILE_SHINGLES", 300)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = families(2)
    got = ngram_join.jaccard_classes(documents(rows), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 4, 85)


def test_null_ids_repeated_rows_and_empty_table(documents):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "a b c d e")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(documents(rows)).collect()), key=str)
    assert got == [(4, 4), (4, 4), (9, 4), (None, None)]
    assert ngram_join.jaccard_classes(documents([])).count() == 0


def test_one_of_each_component_stays(documents):
    docs = documents([(5, "a b c d e f"), (2, "a b c d e f"), (8, "other words stand here now"), (None, "a b c d e f"), (8, "other words stand here now")])
    out = ngram_join.one_per_component(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "8", "None"]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
