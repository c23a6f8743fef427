"""Archives: round trips, framing by other means, and archives that are damaged."""

import gzip
import hashlib
import zlib

import pytest

from skysift.llm import warc

PAGES = "page_id long, url string, html string, digest string, row string"


def brute(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        same = [k for k, _, other in rows if (other or "").encode() == payload]
        newest = max(same, key=lambda k: (k is not None, k or 0))
        kind = ("revisit", newest) if len(payload) >= 1000 and key != newest else ("response", None)
        out.append((key, len(payload), hashlib.sha1(payload).hexdigest(), *kind, True))
    return sorted(out, key=str)


def archived(spark, rows, path):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    return sorted([tuple(r) for r in warc.archived(pages, path).collect()], key=str)


def test_round_trip(spark, tmp_path):
    long = "Ünïcode   page " * 200
    rows = [(i, f"https://e.com/{i}", long + str(i % 7)) for i in range(50)]
    rows += [(100, None, None), (101, "", ""), (102, "http://a b\r\nX: 1", "short"), (103, "u", "short"), (None, "u", "null key" * 3)]
    rows += [(104, "u", "é" * 500), (105, "u", "é" * 500), (106, "u", "x" * 999), (107, "u", "x" * 999), (108, "u", "y" * 3_000_000)]
    assert archived(spark, rows, str(tmp_path / "w")) == brute(rows)


def test_repeated_keys_make_one_response(spark, tmp_path):
    rows = [(7, "u", "z" * 2000)] * 3 + [(3, "u", "z" * 2000), (None, "u", "z" * 2000)]
    got = archived(spark, rows, str(tmp_path / "w"))
    assert sorted(r[3] for r in got) == ["response"] + ["revisit"] * 4
    assert {r[4] for r in got if r[3] == "revisit"} == {7} and [r[0] for r in got if r[3] == "response"] == [7]


def test_empty_table(spark, tmp_path):
    assert archived(spark, [], str(tmp_path / "w")) == []


def test_archives_are_plain_gzip(spark, tmp_path):
    """Another gzip reader sees the same records; texts come back whole; archives stay near their limit."""
    rows = [(i, f"http://e.com/{i}", f"page {i} " * 300) for i in range(40)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    warc.write(warc.planned(pages), str(tmp_path / "w"), limit=2_000)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 3
    for file in files:
        plain, members = gzip.decompress(file.read_bytes()), list(warc.records([file.read_bytes()]))
        assert plain.count(b"WARC/1.1\r\n") == len(members)
        assert members[-1].type == "warcinfo" and all(m.type == "response" for m in members[:-1])
        for one in members:
            assert zlib.decompressobj(31).decompress(file.read_bytes()[one.offset :]).startswith(b"WARC/1.1\r\n")
    back = warc.read(spark, str(tmp_path / "w")).filter("type = 'response'").collect()
    assert {(r.target_uri, r.payload.decode()) for r in back} == {(u, t) for _, u, t in rows}
    assert all(r.intact for r in back)


def pieces(data, n):
    return [data[i : i + n] for i in range(0, len(data), n)]


def example(text=b"hello", **changed):
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "Content-Type": "application/http;msgtype=response"}
    headers["WARC-Payload-Digest"] = warc._sha1(text)
    return warc.member(list({**headers, **changed}.items()), warc._http_head(len(text)) + text)


@pytest.mark.parametrize("n", [1, 7, 100, 1 << 20])
def test_pieces_of_any_size(n):
    data = b"".join(example(str(i).encode() * 40) for i in range(30))
    found = list(warc.records(pieces(data, n)))
    assert [r.payload for r in found] == [str(i).encode() * 40 for i in range(30)]
    assert [data[r.offset : r.offset + 2] for r in found] == [b"\x1f\x8b"] * 30
    assert all(r.intact for r in found)


def test_large_records_come_back_whole():
    text = bytes(range(256)) * 40_000
    (one,) = warc.records(pieces(example(text), 1000))
    assert one.payload == text and one.intact


def test_wrong_digests_are_told():
    assert [r.intact for r in warc.records([example(b"a") + example(b"a", **{"WARC-Payload-Digest": warc._sha1(b"b")})])] == [True, False]


@pytest.mark.parametrize("damage", ["cut", "noise", "two in one", "too long", "too short", "no length"])
def test_damage_is_an_error(damage):
    plain = gzip.decompress(example())
    data = {
        "cut": example()[:-5], "noise": example() + b"noise", "two in one": gzip.compress(plain + plain),
        "too long": gzip.compress(plain.replace(b"\r\n\r\n", b"\r\n\r\nmore", 1)),
        "too short": gzip.compress(plain[:-30]), "no length": gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"),
    }[damage]
    with pytest.raises(warc.BadArchive):
        list(warc.records(pieces(data, 50)))
