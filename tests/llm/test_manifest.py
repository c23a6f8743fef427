"""The Merkle manifest against a plain recursive build."""

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from skysift.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def brute(rows):
    """(doc_id, text, lang, source, n_chars) → expected rows."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append((leaf(row, row[1]), row))
    names = sorted(parts, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda p: (p[1][0] is not None, p[1][0] or 0, p[0]))
        trees[name] = climbed([own for own, _ in parts[name]])
    top = climbed([trees[name][-1][0] for name in names])
    root, out = top[-1][0], []
    for i, name in enumerate(names):
        for at, (own, row) in enumerate(parts[name]):
            way = siblings(trees[name], at) + siblings(top, i)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, row[1].translate(lower)) if changed and row[1] is not None else own
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*[s for left, right in way for s in (*left, *right)])
            out.append((row[0], own, trees[name][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows, **settings):
    docs = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part string, key string"
    )
    changed = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    return merkle.manifest(docs, merkle.one_in_three(), changed, merkle.FIELDS, **settings)


def collected(spark, rows, **settings):
    return sorted([tuple(r) for r in manifest(spark, rows, **settings).collect()], key=str)


def row(i, text="Some Text", lang="en"):
    return (i, text, lang, f"s{(i or 0) % 3}", 9)


def test_equals_plain_tree(spark):
    rows = [row(i, f"Text {i}", f"é{size}") for size in (1, 2, 7, 8, 9, 64, 65, 700) for i in range(size)]
    assert collected(spark, rows) == brute(rows)


def test_one_part_is_the_root(spark):
    rows = [row(i, f"Text {i}") for i in range(20)]
    assert collected(spark, rows) == brute(rows)


def test_several_rounds(spark):
    rows = [row(i, f"Text {i}", "de" if i % 5 else None) for i in range(600)]
    assert collected(spark, rows, block=8) == brute(rows)


def test_nulls_repeats_and_many_parts(spark):
    rows = [row(1), row(1), row(1, None), row(None), row(None, "", None), (2, None, None, None, None), row(3, "x" * 300_000, "")]
    rows += [row(100 + i, "Upper", f"lang{i % 20}") for i in range(40)]
    assert collected(spark, rows) == brute(rows)


def test_only_changed_texts_fail(spark):
    rows = [row(i, "UPPER" if i % 2 else "lower") for i in range(60)]
    got = {r.doc_id: r.verified for r in manifest(spark, rows).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(60)}


def test_empty_table(spark):
    assert collected(spark, []) == []


def test_parent_resumes_the_state_before_a_slot():
    children = [h(str(i)) for i in range(8)]
    parent = merkle.Parent(children)
    for slot in range(8):
        other = [*children[:slot], h("other"), *children[slot + 1 :]]
        assert parent.folded(slot, h("other")) == h(*other)
    assert parent.digest == h(*children)
    # What lies to the left is in the retained state alone.
    parent.children = [None] * 7 + [children[7]]
    assert parent.folded(6, children[6]) == h(*children)
