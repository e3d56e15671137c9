"""Token counts, personal data, the quality model and the language model."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from biolab.llm import kneser_ney, pii, quality_gam, token_counts

from .helpers import EDGE, WORDS, collected, documents


# ------------------------------------------------------------ tokens

def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    chars = [*"abcAB  \n\t'srtve.,!?0123é ñß漢字😀\x1c\x85\r　", "<|endoftext|>", "'re", "  ", "the "]
    texts = EDGE + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["ab" * 2000]
    got = collected(token_counts.count_tokens(documents(spark, texts), path), "doc_id")
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got.n_tokens.tolist() == want
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert got.over_limit.tolist() == [n > 512 for n in want]


def test_empty_repeated_and_very_long_texts(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    assert token_counts.count_tokens(documents(spark, ["a"]).limit(0), path).count() == 0
    long = " ".join(WORDS * 40) + "\n" + "x" * 3000
    c = token_counts.Counter(path, token_counts.proven_table(path))
    monkeypatch.setattr(token_counts, "PIECE", 1000)  # many pieces
    assert len(long) > 60 * token_counts.PIECE and c.count(long) == len(library.encode(long, add_special_tokens=False).ids)
    got = token_counts.count_tokens(documents(spark, [long, long, "a b"], ids=[1, 1, 2]), path).collect()
    assert len(got) == 3 and len({r.n_tokens for r in got if r.doc_id == 1}) == 1


def test_the_proven_table_holds_what_the_library_encodes_as_one_token():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    proven = token_counts.proven_table(path)
    assert len(proven) > 40_000 and len(set(proven)) == len(proven)
    split = token_counts.regex.compile(token_counts.PATTERN).findall
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in proven[::7] if split(t) == [t])


def test_full_cache_is_reset(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "CACHE", 50)
    c = token_counts.Counter(path)
    a = [c.count(f"zq{i}xv{i * 7} ") for i in range(300)]
    assert a == [c.count(f"zq{i}xv{i * 7} ") for i in range(300)]


# ------------------------------------------------------------ personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a@._%-+1234 (). @b2\n") for _ in range(rng.randint(0, 40)))
        want = [[m.span() for m in re.finditer(p, text) if plain(k, m[0])] for k, p in PATTERNS.items()]
        assert pii.base_spans(text) == want


def test_long_digits_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "@" * 1000 + "a" * 300_000)[0] == []


def test_added_spans_take_linear_time():
    """4 MB with a phone and a mail on each line, told apart from base spans and counted in code points; four times as long takes about four times as long."""
    import time

    import pyarrow as pa

    weights, move = pii.default_model()
    line = "é text (312) 555-0199 after six and j.doe@example.com now\n"
    took = []
    for n in (18_000, 72_000):
        text = line * n
        began = time.process_time()
        ((base, more),) = pii.found(pa.array([text]), weights, move)
        took.append(time.process_time() - began)
        assert len(base[0]) == n and len(more[3]) >= 0.9 * n
        s, e = more[3][-1]
        assert "555-0199" in text[s:e] and all(a % len(line) == more[3][0][0] for a, _ in more[3][::1000])
    assert took[1] < 8 * took[0]


HELD_OUT = (
    "reach me under [email:k.lang@ward7.example.net] at any time",
    "forward it to [email:lab_results@example.co.uk] and to the archive",
    "his address is [email:m-o.reilly@post.example.org] since june",
    "[email:info@clinic-north.example.com] has the forms",
    "mail [email:anna99@example.com] or call [phone:+1 (415) 555-0101] today",
    "copy to [email:sales.team@mail.example.io] by noon",
    "the router [ip:172.16.254.1] was replaced",
    "traffic from [ip:203.0.113.77] was blocked at night",
    "ping [ip:8.8.8.8] first",
    "nodes [ip:10.1.2.3] and [ip:10.1.2.4] are up",
    "log in at [ip:198.51.100.23] with the new key",
    "the printer has [ip:192.168.0.50] now",
    "card number [card:4539578763621486] was charged",
    "use [card:5425 2334 3010 9903] for the booking",
    "my card [card:4000-0566-5566-5556] was stolen",
    "they kept [card:6011111111111117] in a file",
    "refund to [card:374245455400126] took a week",
    "the booking was paid with [card:4263 9826 4026 9299] last night",
    "account [card:5555555555554444] ends soon",
    "phone [phone:(312) 555-0199] after six",
    "her office is at [phone:646-555-0175] on weekdays",
    "text [phone:+1 (503) 555-0122] for the code",
    "the desk answers [phone:(206) 555-0143] all day",
    "call [phone:+44 20 7946 0018] from abroad",
    "fax to [phone:808-555-0111] or bring it in",
    "lot 4417 and lot 99123 were sold in 2019",
    "the sum of 1204.50 was paid on 2023-07-01",
    "order 4539578763621487 is late",
    "rooms 12-14 and 20-22 are closed until 10:45",
    "build 4.11.2 replaced build 4.10.9 last week",
    "ticket 555123 has 17 answers and 3 votes",
    "a mean of 12,345 visits in 31 days",
    "see figure 3.2 and table 10.4 of part 2",
    "nothing personal is in this line at all",
)


def test_recall_and_precision_on_a_held_out_table():
    """Of the CRF's labels alone, and of all spans. Words count for labels, spans for spans."""
    rows = pii.labelled_rows(HELD_OUT)
    assert not {t for t, _ in rows} & {t for t, _ in pii.labelled_rows()}
    texts = pii.pa.array([t for t, _ in rows])
    weights, move = pii.default_model()
    data, offsets = pii.text_bytes(texts)
    starts, ends = pii.words(data, offsets)
    first = pii.sequences(data, offsets, starts)
    labels = pii.decoded(pii.emissions(pii.shapes(data, starts, ends), first, weights), first, move)
    gold = np.zeros(len(starts), int)
    for (text, spans), base in zip(rows, offsets):
        for s, e, label in spans:
            gold[(starts < base + e) & (ends > base + s)] = label
    for k in range(1, 5):
        assert ((labels == k) & (gold == k)).sum() >= 0.9 * (gold == k).sum() > 0, pii.KINDS[k - 1]
        assert ((labels == k) & (gold == k)).sum() >= 0.85 * (labels == k).sum(), pii.KINDS[k - 1]
    want = {(i, *span[:2], pii.KINDS[span[2] - 1]) for i, (_, spans) in enumerate(rows) for span in spans}
    got = {(i, s, e, kind) for i, (base, more) in enumerate(pii.found(texts, weights, move)) for kind, a, b in zip(pii.KINDS, base, more) for s, e in a + b}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


def test_falling_apart_changes_no_label():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        first = np.unique(np.concatenate(([0], rng.integers(0, n, 3))))
        score = rng.normal(size=(n, 5)) * rng.choice([0.5, 3])
        score[:, 0] += rng.choice([0, 6], n)
        move = rng.normal(size=(5, 5)) * 0.7
        assert (pii.decoded(score, first, move) == pii.viterbi(score, first, move)).all()


def test_a_long_line_is_one_chain():
    """A phone in three words at any place of a line of 300 words gets the same added span."""
    weights, move = pii.default_model()
    for at in (0, 61, 62, 63, 64, 126, 127, 290):
        text = " ".join([*(["the", "ward", "has", "notes"] * 75)[:at], "call", "(212) 555-0134", "before", "noon", "or", "later"])
        (base, more), = pii.found(pii.pa.array([text]), weights, move)
        s = text.index("(212)")
        assert more[3] == [(s, s + 14)] and base[3] == []


def test_the_querys_columns_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    parts = ["jo@x.org", "10.0.0.7", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "(212) 555-0134", "378282246310005", "é", "\n", ",", *WORDS[:20]]
    texts = EDGE + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    texts += texts[-3:]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(pii.query(spark, str(tmp_path)), "doc_id")
    model = pii.default_model()
    added = 0
    for r, t in zip(got.itertuples(), texts):
        t = t or ""
        base = [sorted(m.span() for m in re.finditer(p, t) if plain(k, m[0])) for k, p in PATTERNS.items()]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, base))
        digest = ",".join(f"{k}:{s}:{e}" for k, of in zip(PATTERNS, base) for s, e in of)
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        (_, more), = pii.found(pii.pa.array([t]), *model)
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, a, b in zip(PATTERNS, base, more) for s, e in sorted(a + b))
        taken = [x for of in base for x in of]
        assert not any(a < e and s < b for of in more for a, b in of for s, e in taken)
        added += sum(map(len, more))
    assert added > 10


def test_crf_adds_layouts_and_keeps_base(spark):
    texts = EDGE + ["é call (212) 555-0134 now", "mail jo@x.org and 10.0.0.7 or 4111 1111 1111 1111 or +1 (017) 555-7713 ok", "order 98079157628 was shipped"]
    got = collected(pii.find_pii(documents(spark, texts)), "doc_id")
    assert got.spans.iloc[-3] == "phone:7:21" and got.n_added.iloc[-3] == 1 and got.n_phone.iloc[-3] == 0
    assert got.iloc[-2][["n_email", "n_ip", "n_card", "n_phone"]].tolist() == [1, 1, 1, 1]
    assert got.spans.iloc[-1] == "" and (got.spans[: len(EDGE)] == "").all()
    red = collected(pii.redact(documents(spark, texts)), "doc_id").text
    assert red.iloc[-3] == "é call <PHONE> now" and red.iloc[0] is None
    assert pii.find_pii(documents(spark, ["a"]).limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(20):
        sizes = rng.integers(1, 5, 4)
        score, move = rng.normal(size=(sizes.sum(), 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
        first = np.cumsum(sizes) - sizes
        got = pii.viterbi(score, first, move)
        for f, n in zip(first, sizes):
            best = max(product(range(3), repeat=int(n)), key=lambda p: sum(score[f + i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
            assert tuple(got[f : f + n]) == best


# ------------------------------------------------------------ quality model

def good_and_bad(n):
    rng = random.Random(9)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        out.append((" ".join(words).capitalize() + ".", 1) if i % 3 else (" ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words), 0))
    return out


def test_gam_learns_and_ignores_held_out_labels(spark):
    rows = good_and_bad(300)
    docs = documents(spark, [t for t, _ in rows] + EDGE)
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    wrong = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    a = collected(quality_gam.score(docs, quality_gam.train(docs, labels)), "doc_id")
    b = collected(quality_gam.score(docs, quality_gam.train(docs, wrong)), "doc_id")
    assert a.score.tolist() == b.score.tolist()
    assert ((a.score[:300] >= 0.7) == [q == 1 for _, q in rows]).mean() > 0.98
    assert a.score.between(0, 1).all()
    kept = quality_gam.keep_good(docs, quality_gam.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == (a.score >= 0.7).sum()


def test_a_score_is_the_plain_sum_of_its_bins():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, len(quality_gam.FEATURES))).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0).astype(float)
    model = quality_gam.fit(x, y)
    assert len(model.pairs) == quality_gam.PAIRS
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.intercept
        for value, edges, table in zip(row, model.edges, model.tables):
            total += table[sum(value >= e for e in edges)]
        for i, j, table in model.pairs:
            total += table[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_held_out_accuracy_on_the_test_data(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    rows = quality_gam.query(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(good) > 10 < len(bad) and auc > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_gam_without_labels(spark):
    docs = documents(spark, EDGE)
    model = quality_gam.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert set(collected(quality_gam.score(docs, model)).score) == {0.5}
    assert quality_gam.score(docs.limit(0), model).count() == 0


def test_gam_pairs_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality_gam.fit(x, y).score(x)
    assert ((p > 0.5) == y).mean() > 0.95


# ------------------------------------------------------------ language model

def tokens(t):
    return [*(t or "").encode().lower().split(), b"\0end"]


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_kneser_ney_equals_brute_force(spark, monkeypatch, tmp_path, shard):
    monkeypatch.setattr(kneser_ney, "SHARD", shard)
    rng = random.Random(4)
    texts = EDGE + [" ".join(rng.choice(WORDS[: rng.choice([5, 50, 400])]) for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["never seen words"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(kneser_ney.query(spark, str(tmp_path)), "doc_id")
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [tokens(t) for t, o in zip(texts, out) if not o]
    c = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip([None, *x], x))
    contexts = Counter(w for _, w in pairs)
    of = lambda counts: (0.0, *kneser_ney.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]))
    up, low = of(pairs), of(contexts)
    free = sum(low[min(v, 3)] for v in contexts.values()) / len(pairs)
    total, back = Counter(), defaultdict(float)
    for (u, _), n in pairs.items():
        total[u] += n
        back[u] += up[min(n, 3)]

    def p(u, w):
        q = (contexts[w] - low[min(contexts[w], 3)]) / len(pairs) + free / (len(c) + 1)
        n = pairs[u, w]
        return (n - up[min(n, 3)]) / total[u] + back[u] / total[u] * q if total[u] else q

    n = sum(c.values())
    for r, t, o in zip(got.itertuples(), texts, out):
        x = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (o, len(x), sum(w in c for w in x), n)
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip([None, *x], x)))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in x))
    assert sum(p(b"w1", w) for w in c) + back[b"w1"] / total[b"w1"] * free / (len(c) + 1) == pytest.approx(1)


def test_kneser_ney_on_an_empty_table(spark):
    docs = documents(spark, ["a"])
    model = kneser_ney.train(docs.limit(0), 1)
    assert kneser_ney.score(docs, model).first().score == 0.0
    assert kneser_ney.score(docs.limit(0), model).count() == 0
