import random

import pytest

from biolab.llm import near_dedup
from biolab.llm.components import components

from .helpers import EDGE, WORDS, collected, documents


def shingle_set(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def variants(seed, groups=12, copies=9):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.choice([6, 8, 12, 30, 80, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(WORDS[:20])
            texts.append(" ".join(text))
    passage = [rng.choice(WORDS) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(WORDS) for _ in range(rng.choice([5, 18, 25, 60]))]) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("long_list", [1, 32])
def test_same_as_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(near_dedup, "LONG_LIST", long_list)
    texts = EDGE + variants(long_list)
    got = collected(near_dedup.near_duplicates(documents(spark, texts)), "doc_id")
    assert list(zip(got.n_shingles, got.component_id)) == brute(texts)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(WORDS[:50])
    docs = documents(spark, [text, text, text, text], ids=[7, 7, None, 9])
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert sorted(r.doc_id or -1 for r in near_dedup.keep_one(docs).collect()) == [-1, 7, 7]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_a_doc_id_with_two_texts_links_what_each_text_links(spark):
    one, two = list(WORDS[:50]), list(WORDS[100:150])
    near = lambda w: " ".join([*w[:49], "changed"])
    docs = documents(spark, [" ".join(one), " ".join(two), near(one), near(two)], ids=[1, 1, 2, 3])
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_exact_mode_needs_no_sketch(spark, monkeypatch, broadcast):
    """With sketches that retain far too little the plain mode may miss links; the exact one gives the brute-force result."""
    monkeypatch.setattr(near_dedup, "K", 8)
    monkeypatch.setattr(near_dedup, "NEED", 7)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast)
    texts = EDGE + variants(5)
    got = collected(near_dedup.near_duplicates(documents(spark, texts), exact=True), "doc_id")
    assert list(zip(got.n_shingles, got.component_id)) == brute(texts)


def test_a_value_in_very_many_sketches_is_broadcast(spark, monkeypatch):
    from biolab.llm import _joins

    monkeypatch.setattr(_joins, "HOT", 1)
    rows = spark.createDataFrame([(1, i) for i in range(1500)] + [(2, 1), (2, 2), (3, 1)], "v long, x long")
    counts = rows.groupBy("v").count().filter("count > 1")
    got = _joins.with_counts(rows, counts, "v", "count", 1500)
    assert sorted(map(tuple, got.groupBy("v", "count").count().toDF("v", "n", "rows").collect())) == [(1, 1500, 1500), (2, 2, 2)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
