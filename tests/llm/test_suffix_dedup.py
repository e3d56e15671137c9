import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from biolab.llm import suffix_dedup
from biolab.llm.external_suffix import Column, Queue, sort_text, suffix_array

from .helpers import EDGE, WORDS, collected, documents


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_with_prefixes_in_memory_and_from_files(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = [rng.randrange(rng.choice([1, 2, 4, 200])) for _ in range(rng.randint(1, 90))] * rng.choice([1, 1, 3])
        cap = rng.choice([3, 20, 200])
        sa, lcp = suffix_array(np.array(text), cap, rng.choice([5, 30, 10**6]))
        best = sorted(range(len(text)), key=lambda i: text[i:])
        assert [text[i : i + cap] for i in sa] == [text[i : i + cap] for i in best] and sorted(sa) == sorted(best)
        for k in range(1, len(text)):
            a, b, n = text[best[k - 1] :], text[best[k] :], 0
            while n < min(cap, len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_memory_stays_under_the_budget_whatever_the_text(tmp_path):
    """A text of 16 times the budget, whose own arrays alone would take more than what is measured."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).tolist()) for _ in range(3000)]
    passage = b" ".join(words[i] for i in rng.integers(0, 3000, 40))
    raw = b" ".join(passage if i % 50 == 0 else words[i] for i in rng.integers(0, 3000, 400_000).tolist())
    text = np.frombuffer(raw[:3_000_000], np.uint8).astype(np.uint16) + 1
    n, budget, got = len(text), 3_000_000 // 16, []
    column = Column(str(tmp_path), "<u2")
    column.append(text)
    before = Queue.spilled
    tracemalloc.start()
    sort_text(column, 257, 50, str(tmp_path), budget, lambda pos, lcp: got.append((hash(pos.tobytes()), int((lcp >= 50).sum()), len(pos))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert Queue.spilled - before > n  # the queues went to disk
    assert sum(g[2] for g in got) == n
    assert peak < 300 * budget < 20 * n  # the text, types, queues, positions and prefixes of all suffixes take over 20 n
    # the same strings are found equal as by sorting them in memory
    whole = Column(str(tmp_path), "<u2")
    whole.append(text)
    more = []
    sort_text(whole, 257, 50, str(tmp_path), 10 * n, lambda pos, lcp: more.append(int((lcp >= 50).sum())))
    assert sum(g[1] for g in got) == sum(more) > 0


def test_the_query_sorts_on_disk(spark, tmp_path):
    """With registered settings a shard has many times the budget; here both are made smaller by one factor, and the sorter
    is asked what it wrote."""
    assert suffix_dedup.SHARD >= 16 * suffix_dedup.BUDGET
    rng = random.Random(3)
    shard = suffix_dedup.Shard(str(tmp_path), 2000)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    texts = [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))) + passage[rng.randint(0, 60) :]).encode() for _ in range(150)]
    for i, t in enumerate(texts):
        one = lambda x: np.array([x])
        shard.add(one(i), one(len(t)), one(i % 7), one(i), np.frombuffer(t, np.uint8))
    assert shard.text.n > 16 * 2000
    before = Queue.spilled
    gone = {}
    for home, number, start, end in shard.covered():
        for h, k, a, b in zip(home.tolist(), number.tolist(), start.tolist(), end.tolist()):
            assert h == k % 7
            gone.setdefault(k, []).append((a, b))
    assert Queue.spilled - before > shard.text.n
    for (n, removed, spans, _), i in zip(brute([t.decode() for t in texts]), range(150)):
        assert (sum(b - a for a, b in gone.get(i, [])), len(gone.get(i, []))) == (removed, spans)


def brute(texts):
    seen, out = set(), []
    for t in texts:
        raw, own = (t or "").encode(), []
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - 49):
            own.append(raw[i : i + 50])
            if raw[i : i + 50] in seen:
                gone[i + 1 : i + 51] = 1
        seen.update(own)
        kept = bytes(c for c, g in zip(raw, gone[1:]) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket,broadcast", [(3000, 0), (16 << 20, 10**6)])
def test_same_as_brute_force(spark, monkeypatch, tmp_path, bucket, broadcast):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SHARD", bucket)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(suffix_dedup, "BUDGET", bucket // 16)
    rng = random.Random(bucket)
    passages = [" ".join(rng.choice(WORDS) for _ in range(25)) for _ in range(5)]
    texts = EDGE + [EDGE[-1], "a" * 300, "a" * 120, "é" * 80, "é" * 60 + "b"]
    for _ in range(60):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages)[rng.randint(0, 30) :], " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 20)))]
        texts.append("".join(parts))
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(suffix_dedup.query(spark, str(tmp_path)), "doc_id")
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == brute(texts)


def test_null_ids_repeats_and_empty(spark, tmp_path):
    text = " ".join(WORDS[:40])
    documents(spark, [text, text, text], ids=[5, 5, None]).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert [r.n_removed for r in suffix_dedup.query(spark, f"{tmp_path}/a").collect()] == [0, 0, 0]
    documents(spark, [text]).limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert suffix_dedup.query(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("bucket", [300, 16 << 20])
def test_texts_of_one_doc_id_are_judged_each(spark, monkeypatch, tmp_path, bucket):
    """Two and more texts of one doc_id, in both row orders: none decides for another, and none takes from another."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SHARD", bucket)
    run = lambda a, b: " ".join(WORDS[a:b])
    rows = [(1, run(0, 90)), (2, run(20, 80) + " x"), (2, run(100, 150)), (2, run(100, 140) + " y"), (2, run(0, 90)), (3, run(110, 200)), (3, run(300, 320)), (3, run(300, 320)), (4, run(300, 330))]
    got = []
    for name, order in (("a", rows), ("b", rows[::-1])):
        documents(spark, [t for _, t in order], ids=[i for i, _ in order]).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got.append(sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, f"{tmp_path}/{name}").collect()))
    starts = lambda t: {t.encode()[i : i + 50] for i in range(len(t) - 49)}
    want = []
    for i, t in rows:
        earlier = set().union(*(starts(u) for j, u in rows if j < i), set())
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - 49):
            if t.encode()[k : k + 50] in earlier:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t.encode(), gone) if not g)
        want.append((i, len(t), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    assert got[0] == got[1] == sorted(want)
