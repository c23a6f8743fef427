import re

import pytest

from skysift.llm import pii

UNIT = "é ab@c.de 1.2.3.4 +49 30 1234567890, 4111 1111 1111 1111; IBAN DE89 3704 0044 0532 0130 00 – x 300.1.1.1\n"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": r"DE[0-9 ]{23}[0-9]{2}",
}


def _holds(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(part) < 256 for part in value.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def _expected(text):
    found = [
        (m.start(), list(KINDS).index(kind), m.end(), kind)
        for kind, pattern in KINDS.items() for m in re.finditer(pattern, text) if _holds(kind, m.group())
    ]
    return sorted(found)


def _masked(text, spans):
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("times", [1, 60, 400])
def test_texts_full_of_spans(documents, times):
    """Across the borders of pieces and of blocks, whatever stands between the spans."""
    text = "".join(UNIT + "y" * (i * 37 % 1_100 if i < 40 else 0) + " " for i in range(times))
    wanted = _expected(text)
    docs = documents([(1, text), (2, None), (3, "")])
    got = {r.doc_id: r.spans for r in pii.found_in(docs).collect()}
    assert [(s.start, s["rank"], s.end, s.kind) for s in got[1]] == wanted and not got[2] and not got[3]
    assert all(text[s.start : s.end] == s.value for s in got[1])
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text == _masked(text, wanted)
    assert out[2].text is None and out[3].text == ""


def test_spans_at_the_border_of_a_piece(documents):
    mail, texts = "ab@c.de", []
    for length in (pii.PIECE - 1, pii.PIECE, pii.PIECE + 1, 2 * pii.PIECE):
        texts += [" " * (length - len(mail)) + mail, " " * length + mail, " " * (length - 3) + mail + " z"]
    out = {r.doc_id: r.text for r in pii.redacted(documents(list(enumerate(texts)))).collect()}
    assert out == {i: text.replace(mail, "<EMAIL>") for i, text in enumerate(texts)}
