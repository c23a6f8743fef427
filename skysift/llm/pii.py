"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust scores.

DataFrame expressions only. The patterns are possessive or anchored, so that matching a text takes time in
proportion to its length and no deep recursion, while they find what the plain patterns would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let

KINDS = ["email", "ip", "card", "phone", "iban"]
BASE_KINDS = KINDS[:4]
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>"
#: What is looked at around a span, and between spans, is cut from pieces of a text of this length: time in proportion to it.
PIECE = 512
#: Lists are built in blocks of so many, for each appending copies what it appends to.
BLOCK = 256
NEAR = 40
LEAST_SCORE = 0.5

# A match may start where the one before ended, or where no character of its first run precedes:
# anywhere else a start inside the run fails just as its beginning did.
_FRESH = r"(?:\G|(?<![{0}]))"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PATTERNS = {
    "email": _FRESH.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _FRESH.format("0-9") + r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Where a code may begin; how far it goes is tried from each such place.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])",
}
# Signs of an account code by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
# The country's own length first; then, as a code of another length or country, all that follows.
_CODES = [rf"^(?:{_BY_COUNTRY})(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"]
# A code of 34 signs with a blank before each from the fifth on, and the sign after it.
_REACH = 65
# What a text must hold for a pattern to be tried.
_HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"),
}
_SCORES = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8}
_CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
_AGAINST = {"ip": ("version", "release"), "card": ("order", "serial"), "phone": ("part", "serial"), "iban": ("serial", "model")}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def worth(place: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - place, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, p: total + worth(p)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits, no blanks) leaves 1 when divided by 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, place: Column) -> Column:
        sign = F.ascii(F.substr(turned, place, F.lit(1)))
        return F.when(sign >= 65, rest * 100 + sign - 55).otherwise(rest * 10 + sign - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        code = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` (exclusive) of the text so cut; no more than its pieces are walked through."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.substr(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))


def _scanned(values: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """One ``kind`` for each value, left to right: ``step`` has a place carried along, 0 at first, and returns its next value as well."""

    def each(state: Column, value: Column) -> Column:
        at, out = step(state["at"], value)
        return F.struct(at.cast("bigint").alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    def block(state: Column, some: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        done = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), each)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    last = F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(blocks, start, block, lambda state: F.flatten(state["out"]))


def _account_codes(pieces: Column, begins: Column) -> Column:
    """Of the places where a code may begin those that hold one, leftmost first and not inside one before."""

    def reached(s: Column) -> Column:
        def tried(tail: Column) -> Column:
            codes = [F.regexp_extract(tail, pattern, 0) for pattern in _CODES]
            return F.coalesce(*[let(c, lambda v: F.when(_confirmed("iban", v), v)) for c in codes], F.lit(""))

        value = let(_between(pieces, s["start"], s["start"] + _REACH), tried)
        return let(value, lambda v: s.withField("value", v).withField("end", s["start"] + F.length(v)))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = s["start"] >= at
        return F.when(fresh, s["end"]).otherwise(at), F.when(fresh, s)

    codes = F.filter(F.transform(begins, reached), lambda s: s["value"] != "")
    return F.filter(let(codes, lambda c: _scanned(c, SPAN[len("array<") : -1], step)), lambda s: s.isNotNull())


def _mentions(around: Column, names: tuple[str, ...]) -> Column:
    return around.rlike("(?:^|[^a-z])(?:" + "|".join(names) + ")") if names else F.lit(False)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, leftmost first: places from the lengths of what lies between."""
    pattern = _PATTERNS[kind]

    def placed(parts: Column) -> Column:
        hits, gaps = parts["hits"], parts["gaps"]
        steps = F.transform(hits, lambda value, i: F.length(F.get(gaps, i)) + F.length(value))
        ends = let(steps, lambda each: _scanned(each, "bigint", lambda at, n: (at + n, at + n)))

        def span(value: Column, end: Column) -> Column:
            return F.struct(
                (end - F.length(value)).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                end.alias("end"),
                F.lit(kind).alias("kind"),
                value.alias("value"),
                F.lit(0.0).alias("score"),
            )

        return F.zip_with(hits, ends, span)

    def scored(pieces: Column, span: Column) -> Column:
        around = F.lower(F.concat_ws(
            "\n",
            _between(pieces, F.greatest(span["start"] - NEAR, F.lit(0)), span["start"]),
            _between(pieces, span["end"], span["end"] + NEAR),
        ))
        near = F.when(_mentions(around, _CONTEXT[kind]), F.lit(0.15)).otherwise(F.lit(0.0))
        far = F.when(_mentions(around, _AGAINST.get(kind, ())), F.lit(0.35)).otherwise(F.lit(0.0))
        return span.withField("score", F.lit(_SCORES[kind]) + near - far)

    def judged(found: Column, pieces: Column) -> Column:
        confirmed = _account_codes(pieces, found) if kind == "iban" else F.filter(found, lambda s: _confirmed(kind, s["value"]))
        kept = F.transform(confirmed, lambda s: scored(pieces, s))
        return kept if kind in BASE_KINDS else F.filter(kept, lambda s: s["score"] >= LEAST_SCORE)

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")
    )
    none = F.array().cast(SPAN)
    some = lambda parts: let(placed(parts), lambda found: let(_pieces(text), lambda pieces: judged(found, pieces)))
    kept = let(both, lambda parts: F.when(F.size(parts["hits"]) > 0, some(parts)).otherwise(none))
    return F.when(_HINTS[kind](text), kept).otherwise(none)


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: struct of start, rank, end, kind, value, score.

    ``start`` and ``end`` (exclusive) count code points. The four plain kinds need pattern and checksum only;
    account codes also need a score of ``LEAST_SCORE``. A null text has none; a long one full of spans takes time in
    proportion to its length, as does its masking.
    """
    return F.array_sort(F.concat(*[_spans(kind, F.coalesce(text, F.lit(""))) for kind in KINDS]))


def digest(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, part), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""

    def replaced(pieces: Column) -> Column:
        # How far the spans before each reach.
        reach = _scanned(found, "bigint", lambda at, s: (F.greatest(at, s["end"]), at))

        def part(s: Column, at: Column) -> Column:
            fresh = F.concat(_between(pieces, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.when(s["start"] >= at, fresh).otherwise(F.lit(""))

        end = F.array_max(F.transform(found, lambda s: s["end"]))
        rest = _between(pieces, end, end + F.length(text))
        return F.concat(F.array_join(F.zip_with(found, reach, part), ""), rest)

    return F.when(F.size(found) > 0, let(_pieces(text), replaced)).otherwise(text)


def found_in(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans`` of every row; other columns are not read, rows are not merged."""
    return docs.select(F.col(key), spans(F.col(text).cast("string")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with masked texts; a ``length`` column, where there is one, follows the new text."""
    body = let(F.col(text).cast("string"), lambda t: let(spans(t), lambda s: masked(t, s)))
    out = docs.withColumn(text, body)
    if length and length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
