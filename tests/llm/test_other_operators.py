import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import katz, mixing, packing, queries, url_rules, vector_index


# --- URL rules -------------------------------------------------------------------------


def test_url_rules(spark):
    draw = random.Random(2)
    hosts = ["example.com", "www.example.com", "m.www.example.com", "badexample.com", "com", "a.net", "EXAMPLE.NET", "x.org", "", "..", "a.com:80"]
    paths = ["", "/", "/en/", "/en/a?x=/fr/", "/es/#q", "/fr/z", "/e"]
    urls = [f"https://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(400)] + [None, "", "nothing", "x://a://b/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_rules.judged(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), url
    assert url_rules.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judged(pages, rules.limit(0), default="block").collect()} == {"block"}


# --- nearest vectors -------------------------------------------------------------------


@pytest.mark.parametrize(("rows", "least"), [(1_500, 0.9), (90, 1.0)])
def test_nearest(spark, rows, least):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, rows)] + rng.normal(size=(rows, 16)) * 0.4
    x[5] = x[4]
    odd = [(9_000, None), (9_100, [0.0] * 16), (9_200, [float("nan")] * 16), (9_300, [None] * 16), (9_400, [1.0]), (9_500, [])]
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(*o, "x") for o in odd], "vec_id long, embedding array<double>, part string")
    out = vector_index.nearest(frame, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    hit = total = 0
    for q in range(0, rows, 10):
        mine = [r for r in out if r.query_id == q]
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(rows), d))[:10]
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(best.tolist()))
        total += 10
    assert hit / total >= least
    assert {r.query_id for r in out} == set(range(0, rows, 10))
    assert vector_index.nearest(frame.limit(0), F.lit(True)).count() == 0


# --- mixing ----------------------------------------------------------------------------


def test_mixing_reaches_targets_and_repeats_itself(spark, documents):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4_000)] + [(9_001, None, None), (9_002, "", None)]
    docs = documents(rows)
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    rates = mixing.repetition_rates(docs, weights)
    got = mixing.mixed(docs, rates, seed=4).collect()
    share = Counter(r.row.source for r in got)
    assert abs(share["small"] - 0.75 * 4_002) < 200 and abs(share["big"] - 0.25 * 4_002) < 130 and share[None] == 0
    assert sorted((r.row.doc_id, r.copy) for r in got) == sorted((r.row.doc_id, r.copy) for r in mixing.mixed(docs.repartition(7), rates, seed=4).collect())
    copies = Counter(r.row.doc_id for r in got if r.row.source == "small")
    rate = 0.75 * 4_002 / 400
    assert abs(np.var([copies.get(i, 0) for i in range(0, 4_000, 10)]) / rate - 1) < 0.3
    assert got[0].row.asDict().keys() == set(docs.columns)
    assert mixing.mixed(documents([]), mixing.repetition_rates(documents([]))).count() == 0


def test_large_means_are_not_cut(documents):
    docs = documents([(i, "t", "one") for i in range(20)])
    out = mixing.mixed(docs, mixing.repetition_rates(docs, rows=4_000), seed=1)
    assert abs(out.count() - 4_000) < 260


# --- packing ---------------------------------------------------------------------------


def plain_fit(sizes, sources, groups, capacity):
    bins, out = [], []
    for s, a, g in zip(sizes, sources, groups):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= s and a not in b["a"] and g not in b["g"]]
        if not fit:
            bins.append({"left": capacity, "a": set(), "g": set()})
        i = min(fit)[1] if fit else len(bins) - 1
        bins[i]["left"] -= s
        bins[i]["a"].add(a)
        bins[i]["g"].add(g)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1]
    sources, groups = rng.integers(0, 150, 400), rng.integers(0, 60, 400)
    assert packing.best_fit(sizes, sources, groups, 100).tolist() == plain_fit(sizes.tolist(), sources, groups, 100)


def test_packing_keeps_every_word_and_no_conflicts(documents):
    draw = random.Random(1)
    rows = [(i, " ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(0, 40))), f"s{draw.randrange(6)}") for i in range(300)]
    rows += [(500, "a " * 257, None), (501, None, "s0"), (502, "b c", "s1"), (502, "b c", "s1"), (None, "d e", None), (None, "d e", None)]
    out = packing.packed(documents(rows), capacity=50, shard_items=100).collect()
    assert sum(r.n_words for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    assert sorted((r.piece, r.first_word, r.n_words) for r in out if r.doc_id == 500) == [(i, 50 * i, 50 if i < 5 else 7) for i in range(6)]
    source, text = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    bins: dict = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 50
        assert len({source[r.doc_id] for r in members}) == len(members) == len({text[r.doc_id] for r in members})
    assert [r.n_words for r in out if r.bin_id is None and r.doc_id == 501] == [0]
    assert packing.packed(documents([])).count() == 0


# --- language model --------------------------------------------------------------------


def plain_katz(rows, learn, kept):
    docs = [(k, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]) for k, t in rows]
    c, b, starts = Counter(), Counter(), sum(map(learn, (k for k, _ in docs)))
    for k, w in docs:
        if learn(k):
            c.update(w)
    n, v = sum(c.values()), len(c)
    known = {w for w, m in c.items() if m * kept >= n}
    for k, w in docs:
        if learn(k):
            b.update((p, x) for p, x in zip(["<s>", *w], w) if (p == "<s>" or p in known) and x in known)
    of = lambda counts: katz.discounts(Counter(counts.values()))
    fw, fp = of(c), of(b)

    def shared(seen, times):
        left = max(1 - seen, 0.5 / (times + 1))
        return left, (1 - left) / seen

    left, scale = shared(sum(fw.get(m, 1) * m for m in c.values()) / n, n)
    own = lambda x: scale * fw.get(c[x], 1) * c[x] / n if c[x] else left
    held, used = Counter(), Counter()
    for (p, x), m in b.items():
        if m >= katz.LEAST_PAIR:
            held[p] += fp.get(m, 1) * m
            used[p] += own(x)

    def given(p, x):
        times = starts if p == "<s>" else c[p]
        if not held[p]:
            return own(x)
        rest, factor = shared(held[p] / times, times)
        m = b[p, x]
        return factor * fp.get(m, 1) * m / times if m >= katz.LEAST_PAIR else rest / (1 - used[p]) * own(x)

    for p in ["<s>", *list(known - {None})[:20]]:
        assert sum(given(p, x) for x in [*c, "never seen"]) == pytest.approx(1)
    out = {}
    for k, w in docs:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[k] = (len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(given(p, x)) for p, x in zip(["<s>", *w], w)))
    return out


@pytest.mark.parametrize("kept", [60, 500_000])
def test_katz_equals_brute_force(documents, monkeypatch, kept):
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 500)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 1_000)
    draw = random.Random(9)
    words = [f"W{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(words, [1 / (j + 1) for j in range(300)], k=draw.randrange(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "fresh words only")]
    learn = lambda k: zlib.crc32(str(k).encode()) % 5 != 1
    want = plain_katz(rows, learn, kept)
    got = katz.scored(documents(rows), F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 1, kept=kept).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (not learn(r.doc_id))
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


def test_katz_null_and_repeated_ids(documents):
    rows = [(None, "a b"), (1, "a b"), (1, "c"), (2, "a b a b")]
    got = katz.scored(documents(rows), F.col("id") == 2).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.held_out) for r in got) == [("1", 2, True), ("1", 3, True), ("2", 5, False), ("None", 3, True)]
    assert katz.scored(documents([]), F.lit(True)).count() == 0
    assert [r.n_known for r in katz.scored(documents([(1, "a")]), F.lit(False)).collect()] == [0]
