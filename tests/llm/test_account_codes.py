import pytest

from skysift.llm import pii

DE, GB = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        (f"IBAN {DE} BIC COBADEFFXXX", [DE]),
        ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]),
        (f"{GB} A new", [GB]),
        (f"{GB} {DE} {GB}", [GB, DE, GB]),
        (f"REF SE12 {DE} OK", [DE]),
        (f"{DE}, {DE}", [DE, DE]),
        ("DE89 3704 0044 0532 0130 01 BIC", []),
        (f"x{DE} {DE}1", []),
    ],
)
def test_capitals_after_an_account_code(documents, text, codes):
    rows = pii.found_in(documents([(1, text)])).collect()
    assert [text[s.start : s.end] for s in rows[0].spans if s.kind == "iban"] == codes
    masked = pii.redacted(documents([(1, text)])).first().text
    assert masked.count("<IBAN>") == len(codes)
