"""The filter audit against filtering in every order."""

import random
import re
from itertools import permutations

from skysift.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def failing(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": smaller,
    }
    return {name for name, failed in fails.items() if failed}


def brute(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    bad = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    docs = []
    for doc_id, text, lang in rows:
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in rows)
        docs.append((lang or "", doc_id, failing(text or "", smaller)))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            alive = [d for d in docs if d[0] == part]
            for step, name in enumerate(order, 1):
                mine = [d for d in docs if d[0] == part and name in d[2]]
                gone = [d for d in alive if name in d[2]]
                alive = [d for d in alive if name not in d[2]]
                out[part, "".join(order), step] = [
                    len(alive), len(gone), len(mine) - len(gone), sum(d[2] == {name} for d in mine),
                    sum(d[1] in good for d in gone), sum(d[1] in bad for d in gone),
                ]
    for part, order, step in out:
        letter = order[step - 1]
        out[part, order, step].append(sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == letter))
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, mask string, part int")
    got = filter_audit.audited(filter_audit.masked(docs), spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


def text(rng):
    n = rng.choice([0, 3, 99, 100, 130])
    words = [f"w{rng.randrange(n if rng.random() < 0.5 else 60)}" for _ in range(n)]
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    if rng.random() < 0.3:
        words.append(rng.choice("#$%&*|"))
    return rng.choice([" ", "\n", "\t "]).join(words)


def test_equals_filtering_in_every_order(spark):
    rng = random.Random(3)
    pool = [text(rng) for _ in range(25)]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(80)]
    rows += [(5, pool[0], "en"), (5, pool[0], "en"), (None, pool[0], "en"), (None, None, "en"), (500, None, None), (501, "", "fr"), (502, "W" * 50_000, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(60)] + [(5, 1, 1), (5, 0, None), (None, 1, 1), (9999, 1, 1)]
    assert audit(spark, rows, labels) == brute(rows, labels)


def test_bounds_of_the_filters(spark):
    rows = [(1, "a b " * 50, "x"), (2, " ".join(f"w{i}" for i in range(99)), "x"), (3, " ".join(f"w{i % 80}" for i in range(100)), "x"),
            (4, " ".join(f"w{i % 79}" for i in range(100)), "x"), (5, "A" + "b" * 9, "x"), (6, "AA" + "b" * 9, "x"), (7, "é" * 9 + "A", "x")]
    assert audit(spark, rows, []) == brute(rows, [])


def test_empty_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    assert len(audit(spark, [(1, "a", "en")], [])) == 600


def test_runs_of_orders():
    """Prefix sums of the interval ends give, for every mask and order, the step of its first failing filter."""
    orders = list(permutations(range(5)))
    for rank, order in enumerate(orders):
        assert filter_audit.lehmer_rank(order) == rank
    ends = filter_audit.interval_ends()
    for mask in range(1, 32):
        for step in range(1, 6):
            removed = [sum(e[3] for e in ends if e[:2] == (mask, step) and e[2] <= rank) for rank in range(120)]
            wanted = [int(mask >> o[step - 1] & 1 and not any(mask >> f & 1 for f in o[: step - 1])) for o in orders]
            assert removed == wanted
