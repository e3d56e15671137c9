"""The language model of order 3, as registered, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from biolab.llm import kneser_ney, queries

from .helpers import EDGE, WORDS, collected, documents
from .test_scorers import tokens


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_registered_model_has_order_3(spark, monkeypatch, tmp_path, shard):
    monkeypatch.setattr(kneser_ney, "SHARD", shard)
    rng = random.Random(6)
    texts = EDGE + [" ".join(rng.choice(WORDS[: rng.choice([3, 8, 50, 400])]) for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["never seen words", "w1 never w2 w1 w2"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(queries.QUERIES["op9_kneser_ney"](spark, str(tmp_path)), "doc_id")
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [tokens(t) for t, o in zip(texts, out) if not o]
    vocabulary = {w for x in train for w in x}
    triples = Counter(t for x in train for t in zip([None, *x], x, x[1:]))
    raw = Counter(p for x in train for p in zip([None, *x], x))
    pairs = Counter((v, w) for _, v, w in triples) + Counter({p: n for p, n in raw.items() if p[0] is None})
    contexts = Counter(w for _, w in raw)
    assert set(pairs) == set(raw)
    of = lambda counts: (0.0, *kneser_ney.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]))

    def level(counts, below):
        d, total, back = of(counts), Counter(), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            back[g[:-1]] += d[min(n, 3)]

        def p(*g):
            h, n = g[:-1], counts[g]
            return (n - d[min(n, 3)] + back[h] * below(*g[1:])) / total[h] if total[h] else below(*g[1:])

        return p

    low = of(contexts)
    free = sum(low[min(n, 3)] for n in contexts.values()) / len(raw) / (len(vocabulary) + 1)
    p2 = level(pairs, lambda w: (contexts[w] - low[min(contexts[w], 3)]) / len(raw) + free)
    p3 = level(triples, p2)
    for r, t in zip(got.itertuples(), texts):
        x = tokens(t)
        assert r.score == pytest.approx(math.log10(p2(None, x[0])) + sum(math.log10(p3(*g)) for g in zip([None, *x], x, x[1:])))
    assert sum(p3(b"w1", b"w2", w) for w in [*vocabulary, b"unknown"]) == pytest.approx(1)


def test_order_is_checked_and_an_empty_table_is_uniform(spark):
    docs = documents(spark, ["a"])
    assert kneser_ney.score(docs, kneser_ney.train(docs.limit(0), 1, order=3)).first().score == 0.0
    with pytest.raises(ValueError):
        kneser_ney.train(docs, 1, order=4)


def test_pairs_of_too_many_words_are_refused(spark):
    """A pair of word numbers is a 64-bit number; past that training says so instead of wrapping around."""
    class Vocabulary:
        def __len__(self):
            return 1 << 32

    with pytest.raises(ValueError, match="64 bits"):
        kneser_ney.count_pairs(None, "", Vocabulary(), 1, None, 2)
