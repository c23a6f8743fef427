import random
import re

import pytest
from pyspark.sql import functions as F

from skysift.llm import license_scan, pii, quality_rules, toxicity

LONG = "word " * 60_000


def test_quality_counts(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g h " * 3), (5, "x # $y\n\n x # $y\nz"), (6, LONG), (6, "é ü")]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judged(documents(rows), []).collect())
    want = []
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        places: dict = {}
        for i in range(len(w) - 7):
            places.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((key, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want)


def test_rules_are_learned_and_applied(documents, quality_labels):
    draw = random.Random(3)
    clean = [" ".join(f"{draw.choice('abcdefgh')}{i}" for i in range(40)) for _ in range(150)]
    rows = [(i, t if i % 3 else t.replace(" ", "## ")) for i, t in enumerate(clean)]
    labels = quality_labels([(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 0, 0), (3, None, 1)])
    rules = quality_rules.fit(documents(rows), labels)
    assert rules and all(len(r) for r in rules)
    kept = {r.doc_id for r in quality_rules.good_documents(documents(rows), rules).collect()}
    assert kept == {i for i, _ in rows if i % 3}
    assert quality_rules.good_documents(documents(rows), rules).columns == documents(rows).columns
    assert quality_rules.fit(documents([]), quality_labels([])) == []


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_base_spans_equal_plain_patterns(documents):
    draw = random.Random(5)
    bits = ["a@b.c", "a@b.c_d@e.f", "x.y+z@host-1.example.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.1.1.01", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1((((((((2", "@", "é😀", " ", "\n", "5", ".", "+", "-"]
    rows = [(i, "".join(draw.choices(bits, k=30))) for i in range(120)] + [(900, None), (901, ""), (902, "a" * 50_000 + "@"), (903, "1" * 50_000), (904, "a@b" + ".c" * 20_000)]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans if s.kind in PLAIN] for r in pii.found_in(documents(rows)).collect()}
    for key, text in rows:
        want = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) if len(text or "") < 9_000 for m in re.finditer(p, text or "") if confirmed(k, m.group())]
        if key < 902:
            assert got[key] == [(a, b, k) for a, _, b, k in sorted(want)]
    assert got[902] == [] and got[904] == [(0, 40_003, "email")]


def test_account_codes_and_masking(documents):
    text = "Transfer to account DE89 3704 0044 0532 0130 00 now, not DE88370400440532013000; mail a.b@c.de or +1 (988) 555-2485"
    docs = documents([(1, text), (2, "clean"), (3, None)])
    spans = {r.doc_id: [(s.kind, text[s.start : s.end]) for s in r.spans] for r in pii.found_in(docs).collect()}
    assert spans[1] == [("iban", "DE89 3704 0044 0532 0130 00"), ("email", "a.b@c.de"), ("phone", "+1 (988) 555-2485")]
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text == "Transfer to account <IBAN> now, not DE88370400440532013000; mail <EMAIL> or <PHONE>"
    assert out[1].n_chars == len(out[1].text) and (out[2].text, out[3].text) == ("clean", None)
    assert pii.redacted(docs).columns == docs.columns


def test_notices(documents):
    rows = [
        (1, "Under the GNU  General-Public License and the Apache License; apache license"), (2, "gnu genral public licence here"), (3, "mit lizenz"),
        (4, "CC BY-NC"), (5, None), (6, ""), (7, "the mit licence"), (8, LONG + "apache licence"), (9, "é gnu général public license"),
    ]
    got = {r.doc_id: r for r in license_scan.notices(documents(rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (12, 3, 2, 10, "apache,gpl", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels) == (0, None, "", "gpl")
    assert [(s.label, s.first_word, s.n_words, s.edits) for s in got[2].spans] == [("gpl", 0, 4, 2)]
    assert (got[3].labels, got[4].base_labels, got[5].n_words, got[6].labels) == ("", "cc-by", 0, "")
    assert (got[7].labels, got[8].labels, got[8].spans[0].first_word) == ("mit", "apache", 60_000)
    assert got[9].labels == "gpl" and 0 < got[9].score < 1
    assert license_scan.notices(documents([])).count() == 0


@pytest.fixture
def spoken(documents, quality_labels):
    draw = random.Random(7)
    words = ["hello", "there", "people", "morning", "letter", "summer", "winter", "garden", "tomorrow", "evening"]
    bad = ["idiot", "moron", "stupid"]
    rows = [(i, " ".join(draw.choices(words, k=30) + ([draw.choice(bad)] if i % 4 == 0 else []))) for i in range(600)]
    return rows, quality_labels([(i, 1, int(i % 4 == 0)) for i in range(600)])


def test_toxicity_restores_and_scores(documents, spoken):
    rows, labels = spoken
    extra = [(1000, "hello 1d1ot there"), (1001, "hello s t u p i d there"), (1002, "summer moooron"), (1003, "summer garden"), (1004, None), (1005, ""), (None, "hello")]
    out = toxicity.scored(documents(rows + extra), labels, F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    got = {r.doc_id: r for r in out.collect()}
    held = [r for k, r in got.items() if k is not None and k < 600 and r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 607


def test_toxicity_without_labels(documents, quality_labels):
    out = toxicity.scored(documents([(1, "a"), (2, None)]), quality_labels([]), F.lit(True)).collect()
    assert [r.predicted for r in out] == [0, 0]
    assert toxicity.scored(documents([]), quality_labels([]), F.lit(True)).count() == 0
