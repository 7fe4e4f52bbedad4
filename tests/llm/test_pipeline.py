from __future__ import annotations

import collections
import os
import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't there")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.toPandas()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), "test")
        after = docs.toPandas()
        assert list(after.columns) == list(before.columns) and set(after["doc_id"]) <= set(before["doc_id"])
        if name == "exact dedup":
            norm = lambda x: " ".join(t for t in __import__("re").split(r"[\x20\x09-\x0D]+", x))
            want = before.assign(t=before["text"].fillna("").map(norm)).groupby("t")["doc_id"].min()
            assert set(after["doc_id"]) == set(want)
        before = after
    mixed = corpus_pipeline.mixture(spark, docs, DATA)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert max(copies.values()) <= 2
    out = corpus_pipeline.tokens(spark, mixed, DATA).limit(20).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_text"] == text[r["doc_id"]] for r in out)


def test_awkward_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "word " * 50_000, "en", None, 250_000, "x"), (3, "some text here", None, "a", 14, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, name string")
    labelled = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, DATA), "test")
    assert docs.count() >= 1 and docs.where("doc_id = 1").count() <= 1
    assert corpus_pipeline.tokens(spark, docs, DATA).count() == docs.count()
    assert corpus_pipeline.quality.fit(docs, labelled) is None
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, DATA).count() == 0


def test_rows_without_an_id_pass_all_stages(spark):
    long, other, third = (" ".join(f"{w}{i}" for i in range(400)) for w in ("alpha", "beta", "gamma"))
    near = long.replace("alpha7 ", "changed ")
    rows = [(None, other, "en", "a", 1), (7, other, "en", "a", 2), (None, third, "en", "a", 3), (None, third, "en", "a", 4), (5, long, "en", "a", 5), (None, near, "en", "a", 6), (None, third.replace("gamma9 ", "changed "), "en", "a", 7), (3, "delta " * 300, "en", "a", 8), (None, None, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = corpus_pipeline.materialise(docs, "test")

    def ids_and_texts(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    exact = corpus_pipeline.materialise(corpus_pipeline.exact_duplicates(spark, docs, DATA), "test")
    changed = third.replace("gamma9 ", "changed ")
    want = [(7, other), (None, third), (5, long), (None, near), (None, changed), (3, "delta " * 300), (None, None)]
    assert ids_and_texts(exact) == sorted(want, key=str)
    # the copy with an id wins over the near copy without one; of two near copies without an id one stays
    unique = corpus_pipeline.materialise(corpus_pipeline.near_duplicates(spark, exact, DATA), "test")
    got = ids_and_texts(unique)
    stays = [t for i, t in got if i is None and t]
    assert len(stays) == 1 and stays[0] in (third, changed)
    assert got == sorted([(7, other), (None, stays[0]), (5, long), (3, "delta " * 300), (None, None)], key=str)
    # the source takes 1.5 times its words, so each text is there once or twice; a row without words takes none
    mixed = corpus_pipeline.mixture(spark, unique, DATA)
    assert mixed.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} == {(i, t) for i, t in got if t}


def test_ids_for_rows_without_one_are_dense_and_beyond_all_others(spark):
    docs = spark.createDataFrame([(i if i % 3 else None, str(i)) for i in range(60)], "doc_id long, text string").repartition(4)
    rows = corpus_pipeline.with_ids(docs).collect()
    assert sorted(r["doc_id"] for r in rows if r["_nameless"]) == list(range(60, 80))
    assert {r["doc_id"] for r in rows if not r["_nameless"]} == {i for i in range(60) if i % 3}


def test_columns_named_like_those_of_stages_pass_through(spark):
    names = ["_row", "_score", "_copies", "_copy", "_nameless", "_ROW2", "row", "node", "cluster", "token", "decoded_text"]
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(50 + i)), "en", "ab"[i % 2], 1, *[f"{n}{i}" for n in names]) for i in range(12)]
    rows += [(None, "", "en", "a", 1, *names), (None, None, None, None, None, *names), (40, rows[3][1], "en", "a", 1, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, schema), "test")
    given = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.materialise(stage(spark, docs, DATA), "test")
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= given
        docs = out
    out = corpus_pipeline.tokens(spark, docs, DATA)
    assert set(docs.columns) - set(out.columns) == {"text"} and {r["decoded_text"] for r in out.collect()} <= {r[1] for r in rows}


def test_near_duplicates_equal_brute_force(spark):
    """5 words, 0.8: one of each component stays, over a sample of real texts and near copies of them."""
    r = random.Random(6)
    base = [x["text"].split() for x in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").orderBy("doc_id").select("text").collect()]
    base = [w for w in base if 20 <= len(w) <= 200][:40]
    texts = [w for b in base for w in (b, [x if r.random() > 0.01 else "changed" for x in b], [x if r.random() > 0.05 else "else" for x in b])]
    sets = [frozenset(tuple(x.lower() for x in w[p : p + 5]) for p in range(len(w) - 4)) for w in texts]
    first = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if first[a] != first[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
                    changed = True
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert got == [i for i in range(len(texts)) if first[i] == i]


def test_mixture_takes_whole_copies_near_the_targets(spark):
    rows = [(i, " ".join(["word"] * (20 + i % 80)), "en", "abc"[min(i % 10, 2)], 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = collections.Counter()
    for i, t, _, s, _ in rows:
        size[s] += 20 + i % 80
    total, got = sum(size.values()), collections.Counter()
    for r in corpus_pipeline.mixture(spark, docs, DATA).collect():
        got[r["source"]] += 20 + r["doc_id"] % 80
    # a and b can't take more than twice their size: c takes what is left
    assert size["a"] + size["b"] < total / 4
    want = {"a": 2 * size["a"], "b": 2 * size["b"], "c": 1.5 * total - 2 * size["a"] - 2 * size["b"]}
    assert all(abs(got[s] - want[s]) < 0.03 * want[s] for s in want)
