"""Clustering, ranked search and language identification against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import clustering, language, lexical_search
from tests.llm.test_operators import awkward

TABLE = "vec_id long, embedding array<float>, cluster string, v string"


def brute_clusters(rows, k, rounds, dims, scale):
    own = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [list(v) for _, v in sorted(own, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in own:
            groups[near(v)[1]].append(v)
        for i, vs in groups.items():
            centres[i] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *reversed(near(v))) for i, v in own]
    parts = Counter()
    for _, c, d in out:
        parts[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = lambda x: min(x, 2**63 - 1)
    return sorted(((i, c, long(d), long(parts[c]), long(sum(parts.values())), name[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("spread", [1.0, 1e9])
def test_clusters_equal_brute_force(spark, spread):
    r = random.Random(int(spread))
    rows = [(i, [r.gauss(i % 5, 1) * spread for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(80)]  # one very common vector
    rows += [(7, [0.25] * 6), (7, [0.25] * 6), (300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [float("nan")] * 6), (306, [float("-inf")] + [0.0] * 5), (None, [-0.001] * 6), (307, [-1e-30] * 6)]
    df = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], TABLE).repartition(7)
    got = sorted((tuple(x) for x in clustering.cluster(df, k=8, dims=6).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == brute_clusters(rows, 8, 3, 6, 64)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame([(i, e, "", "") for i, e in few], TABLE)
    assert sorted(tuple(x) for x in clustering.cluster(df, k=16, dims=2).collect()) == brute_clusters(few, 16, 3, 2, 64)
    assert clustering.cluster(df.limit(0), dims=2).count() == 0
    assert clustering.cluster(df, dims=64).count() == 0


def test_pivots_spare_distances_and_lose_none():
    r = np.random.default_rng(4)
    v = r.integers(-40, 40, (3000, 8)) + np.repeat(r.integers(-400, 400, (10, 8)), 300, axis=0)
    centres, pivots = v[::300].copy(), clustering.choose_pivots(v[5:261], 6)
    away = lambda x: np.stack([np.sqrt(clustering.squared(x, p).astype(float)) for p in pivots], 1)
    low = clustering.bounds(away(v), away(centres))
    exact = ((v[:, None] - centres[None]) ** 2).sum(2)
    assert (low <= exact).all()
    which, best, computed = clustering.nearest(v, low, centres)
    assert (which == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert computed < exact.size / 2


def brute_search(docs, items, k):
    held = [(i, lexical_search.terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            tf, m = Counter(t), 25 + 75 * len(t) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in lexical_search.terms_of(text) if tf[x])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TOGETHER", 3)
    rows = [(i, t) for i, t, _ in awkward()] + [(None, "one two abc"), (900, "ONE\ttwo—İı 日本語 x"), (901, "日本語,日本語 ñandú"), (902, "a_b\x00c\x7fd")]
    r = random.Random(2)
    texts = [t for _, t in rows if t]
    items = [(i, " ".join(r.choice(r.choice(texts).split() or ["x"]) for _ in range(r.randint(1, 60)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowherefound"), (43, "one one TWO two"), (44, "日本語 ñandú d"), (45, " ".join(texts[9].split()[:80])), (43, "repeated row of text")]
    docs = spark.createDataFrame([(i, t, "z", 1.0) for i, t in rows], "doc_id long, text string, item_id string, score double").repartition(5)
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    for blocks in (1 << 17, 40):
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", blocks)
        got = sorted((tuple(x) for x in lexical_search.search(docs, asked, k=4).collect()), key=str)
        assert got == brute_search(rows, items, 4)
    assert lexical_search.search(docs.limit(0), asked).count() == 0
    assert lexical_search.search(docs, asked.limit(0)).count() == 0


def test_intervals_are_bounded_and_few_documents_scored():
    r = np.random.default_rng(6)
    size, terms = 2000, 40
    places = [np.flatnonzero(r.random(size) < p) for p in np.linspace(0.001, 0.9, terms)]
    counts = np.array([len(p) for p in places])
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * c + 1))) for c in counts])
    tfs = r.integers(1, 6, counts.sum())
    segment = lexical_search.Segment(np.arange(size) * 3, np.full(size, 50), np.arange(terms), counts, np.concatenate(places), tfs, weights, size, 50 * size)
    best = lexical_search.Best(1, 10)
    scored = lexical_search.search_segment(segment, [{t: 1 for t in range(terms)}], 0, best)
    exact = np.bincount(np.concatenate(places), segment.impact, size)
    order = np.lexsort((np.arange(size), -exact))[:10]
    assert best.doc.tolist() == (order * 3).tolist() and best.score.tolist() == exact[order].astype(int).tolist()
    assert scored < size / 2
    own = lexical_search.Items(segment, [{t: 1 for t in range(terms)}])
    for low, high in ((0, size), (17, 18), (100, 163), (5, 6)):
        bound, split = own.bounds(np.array([0]), np.array([low]), np.array([high]))
        assert bound[0] >= exact[low:high].max() and low <= split[0] < high


def test_language_of_mixtures(spark):
    r = random.Random(3)
    parts = {"en": ["th", "e", "ing", "and", "of"], "fr": ["eau", "x", "ré", "que", "le"], "de": ["sch", "ung", "ü", "ber", "ich"]}
    word = lambda x: "".join(r.choice(parts[x]) for _ in range(r.randint(1, 4)))
    text = lambda x, n: " ".join(word(x) for _ in range(n))
    rows = [(i, text(x, 80), x) for i in range(300) for x in [("en", "fr", "de")[i % 3]]]
    docs = spark.createDataFrame([(*x, "s", 2.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    model = language.fit(docs.where(~language.held_out()))
    assert model.languages == ["de", "en", "fr"]
    got = {x["doc_id"]: x for x in language.predict(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and all(got[i]["lang_pred"] == x for i, _, x in rows if i in held)
    mixed = [(0, text("en", 70) + " " + text("fr", 30)), (1, text("de", 50)), (2, None), (3, ""), (4, " 12 -- !? "), (5, "— 🙂"), (6, "日本語"), (7, text("de", 9000) + " " + text("en", 3000)), (8, text("fr", 1)), (8, text("fr", 1))]
    found = language.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    by = {x["doc_id"]: x for x in found}
    assert len(found) == len(mixed)
    assert by[0]["lang_set"] == ["en", "fr"] and abs(by[0]["score"] - 0.7) < 0.06
    assert by[1]["lang_set"] == ["de"] and by[1]["score"] == 1.0
    assert by[7]["lang_set"] == ["de", "en"] and abs(by[7]["score"] - 0.75) < 0.03
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (2, 3, 4, 5)] == [("und", 0.0)] * 4
    assert by[6]["lang_pred"] in model.languages
    none = language.fit(docs.limit(0))
    assert [x["lang_pred"] for x in language.predict(docs.limit(3), none).collect()] == ["und"] * 3
    assert language.predict(docs.limit(0), model).count() == 0


def test_word_likelihoods_equal_brute_force(spark):
    rows = [(1, "abab ba Ab", "x"), (2, "ab é", "y"), (3, None, "x"), (4, "ab", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    triples, pairs = defaultdict(Counter), defaultdict(Counter)
    frame = lambda w: [32, *w.encode(), 32]
    for _, t, x in rows[:2]:
        for w in t.lower().split():
            f = frame(w)
            triples[x].update(zip(f, f[1:], f[2:]))
            pairs[x].update(zip(f, f[1:-1]))
    words = ["ab", "é", "zz", "abab"]
    got = model.word_logs(pa.array([w.encode() for w in words], pa.large_binary()))
    for i, w in enumerate(words):
        f = frame(w)
        for j, x in enumerate(model.languages):
            want = sum(math.log((triples[x][g] + language.SMOOTH / 256) / (pairs[x][g[:2]] + language.SMOOTH)) for g in zip(f, f[1:], f[2:]))
            assert abs(got[i, j] - want) < 1e-4


def test_proportions_climb_to_the_likeliest():
    r = np.random.default_rng(8)
    p = r.random((200, 2)) ** 4
    times = r.integers(1, 4, 200)
    theta, log = language.proportions(p, times, np.array([0]), np.ones((1, 2)))
    grid = np.linspace(1e-6, 1 - 1e-6, 20001)
    all_logs = (times[:, None] * np.log(p[:, :1] * grid + p[:, 1:] * (1 - grid))).sum(0)
    assert log[0] >= all_logs.max() - 0.05 and abs(theta[0, 0] - grid[all_logs.argmax()]) < 0.02
