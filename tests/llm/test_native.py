"""Decontamination, mixing, quality rules, line dedup, and the pipeline, against brute force and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from biolab.llm import _joins, decontaminate, line_dedup, mixing, quality_rules

from .helpers import CLASHES, EDGE, WORDS, collected, documents


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def grams(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))]
        parts += [rng.choice(lines) for _ in range(rng.randint(0, 5))] + [lines[0]] * (rng.random() < 0.3)
        if rng.random() < 0.2:
            parts *= 3
        rng.shuffle(parts)
        out.append("\n".join(parts) + rng.choice(["", "\n", " # | $"]))
    return out


def runs(t, lengths):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + k]) for k in lengths for i in range(len(w) - k + 1)}


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 70))) for _ in range(25)] + [None, "", "short one"]
    lengths = {len(words(t)) for t in items} & {1, 2, 3, 4}
    texts = EDGE + ["short one", "Short  ONE", "not short one"]
    for _ in range(60):
        w = words(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join([*(rng.choice(WORDS) for _ in range(rng.randint(0, 90))), *w, *(rng.choice(WORDS) for _ in range(20))]))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.find(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, u in enumerate(items):
            a, b = grams(t) | runs(t, lengths), grams(u)
            if b and 100 * len(a & b) >= 75 * len(b):
                want[i, j] = (len(a & b), len(b))
    assert got == want and len(want) > 20
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.find(docs.limit(0), bench).count() == 0 == decontaminate.find(docs, bench.limit(0)).count()


def test_sketches_decide_and_save_work(spark, monkeypatch):
    """What the sketches don't nominate isn't found, and they meet fewer rows than whole item sets would."""
    rng = random.Random(7)
    item = " ".join(rng.choice(WORDS) for _ in range(100))
    docs = documents(spark, [item, item + " more", " ".join(WORDS)])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    items = decontaminate.item_table(bench)
    assert items.filter("in_sketch").count() < 0.45 * items.count()
    assert decontaminate.find(docs, bench).count() == 2
    whole = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda *a: whole(*a).filter("doc_id <> 1"))
    assert [r.doc_id for r in decontaminate.find(docs, bench).collect()] == [0]


def test_each_row_is_judged_by_its_own_text(spark):
    words_ = [f"z{i}" for i in range(24)]
    halves = [" ".join(words_[:14]), " ".join(words_[10:])]
    bench = spark.createDataFrame([(0, " ".join(words_)), (1, "z3 z4")], "item_id long, text string")
    docs = documents(spark, [*halves, *halves, " ".join(words_), " ".join(words_)], ids=[None, None, 4, 4, None, 7])
    got = sorted((r.doc_id or -1, r.item_id, r.n_shared) for r in decontaminate.find(docs, bench).collect())
    assert got == [(-1, 0, 20), (-1, 1, 1), (-1, 1, 1), (4, 1, 1), (7, 0, 20), (7, 1, 1)]
    assert sorted(r.doc_id or -1 for r in decontaminate.remove(docs, bench).collect()) == [-1, 4]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_salts_what_is_too_large_to_broadcast(spark, how):
    docs = documents(spark, ["t"] * 50, [None if i % 5 == 0 else f"s{i % 4}" for i in range(50)])
    table = spark.createDataFrame([(None, 1), ("s1", 2), ("s2", 3)], "of string, v long")
    wide, small = (_joins.attach(docs, docs["source"], table, "of", most, how) for most in (0, 10))
    assert wide[1] == small[1] == "_row__" and wide[0].columns == small[0].columns == [*docs.columns, "_row__"]
    rows = lambda x: sorted((r["doc_id"], None if r["_row__"] is None else r["_row__"]["v"]) for r in x[0].collect())
    assert rows(wide) == rows(small) and len(rows(wide)) == (50 if how == "left" else 50 - sum(i % 5 > 0 and i % 4 in (0, 3) for i in range(50)))


def test_extra_columns_stay_as_they_are(spark, monkeypatch):
    docs = documents(spark, ["a b c\nfooter"] * 3 + EDGE)
    bench = spark.createDataFrame([(0, "no such item in here at all")], "item_id long, text string")
    for most in (100_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", most)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", most)
        for out in (line_dedup.dedup(docs, most=0.5), decontaminate.remove(docs, bench), mixing.mix(docs)):
            rows = out.collect()
            assert rows and all([r[c] for c in CLASHES] == CLASHES for r in rows)
        assert quality_rules.judge(docs).count() == docs.count()
    again = mixing.mix(mixing.mix(docs))
    assert again.columns[-2:] == ["mix_copy", "mix_copy_"] and again.count()


def test_repeated_rows_and_ties(spark):
    text = " ".join(WORDS[:30])
    docs = documents(spark, [text] * 4 + [text + "\nx"] * 2, ["a"] * 6, ids=[1, 1, 2, 2, 3, 3])
    bench = spark.createDataFrame([(5, text), (6, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()) == [(d, i) for d in (1, 2, 3) for i in (5, 6)]
    copies = [(r.doc_id, r.copies) for r in mixing.plan(docs).collect()]
    assert len(copies) == 6 and len(set(copies)) == 3  # repeated rows draw alike
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == 6 and len({r.n_words for r in judged if r.doc_id < 3}) == 1
    assert [r.text for r in line_dedup.dedup(docs, min_pages=2, ratio=0.4).filter("doc_id = 3").collect()] == ["x", "x"]


def fill(total, shares, caps):
    """Water filling by raising the level through the caps, one source at a time."""
    open_, held = set(range(len(caps))), 0.0
    while open_:
        level = (total - held) / sum(shares[i] for i in open_)
        full = {i for i in open_ if caps[i] < shares[i] * level}
        if not full:
            return [shares[i] * level if i in open_ else caps[i] for i in range(len(caps))]
        held += sum(caps[i] for i in full)
        open_ -= full
    return caps


def test_mixing(spark):
    texts = EDGE + corpus(3, 300)
    sources = [None if i % 11 == 0 else ["a", "b", "B", "é", "zz", "empty"][min(i * i % 7, 4)] for i in range(len(texts))]
    texts.append("")
    sources.append("empty")
    docs = documents(spark, texts, sources)
    plan = collected(mixing.plan(docs), "doc_id")
    size = [len(words(t)) for t in texts]
    assert plan["size"].tolist() == size
    order = sorted(set(sources), key=lambda s: (s is None, s or ""))
    totals = {s: sum(n for n, of in zip(size, sources) if of == s) for s in order}
    want = dict(zip(order, fill(1.5 * sum(size), [(3, 1, 2)[k % 3] for k in range(len(order))], [2 * totals[s] for s in order])))
    taken = Counter()
    for r, s, n in zip(plan.itertuples(), sources, size):
        assert r.target == pytest.approx(want[s]) and r.source_size == totals[s] and r.copies <= 2
        taken[s] += n * r.copies
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + max(size) * 0.1
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in plan.itertuples() if r.copies})
    assert mixing.plan(docs.limit(0)).count() == 0 == mixing.mix(docs.limit(0)).count()


@pytest.mark.parametrize("n", [1, 40, 400])
def test_water_filling_is_exact_for_any_number_of_sources(spark, n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 5, 5, 100, 10**6]) for _ in range(n)]
    table = spark.createDataFrame([(f"s{i:04}", s, i) for i, s in enumerate(sizes)], "source string, source_size long, rank long")
    got = [r.target for r in mixing.targets(table, mixing.Scratch(spark, "t")).orderBy("rank").collect()]
    assert got == pytest.approx(fill(1.5 * sum(sizes), [(3, 1, 2)[k % 3] for k in range(n)], [2.0 * s for s in sizes]))


def test_a_copy_is_drawn_with_the_probability_of_the_fraction(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for rate in (0.25, 1.6):
        got = ids.select(mixing.copies_of(mixing.F.lit(rate)).alias("n")).groupBy("n").count().collect()
        share = {r["n"]: r["count"] / 20_000 for r in got}
        assert set(share) == {int(rate), int(rate) + 1} and abs(share[int(rate) + 1] - rate % 1) < 0.015


def rules(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_and_host_verdicts(spark):
    texts = EDGE + corpus(4) + ["a b c d e f g h " * 9, "é ü " * 30]
    bad = ["tiny"] * 40
    docs = documents(spark, texts + bad, [None if i % 9 == 0 else "good" for i in range(len(texts))] + ["bad"] * 40)
    got = collected(quality_rules.judge(docs), "doc_id")
    for r, t in zip(got.itertuples(), texts + bad):
        n = rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert not got.kept[got.host == "bad"].any() and got.kept[(got.host == "good") & ~got.base_failed].all()
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_a_good_page_of_a_bad_host_goes_with_it(spark):
    good = " ".join(WORDS[:60])
    docs = documents(spark, ["tiny"] * 60 + [good] * 60, ["bad"] * 59 + ["ok"] + ["ok"] * 59 + ["bad"])
    got = collected(quality_rules.judge(docs), "doc_id")
    assert not got.kept.iloc[-1] and not got.base_failed.iloc[-1] and got.kept.iloc[70]


@pytest.mark.parametrize("ratio, most", [(line_dedup.RATIO, line_dedup.MOST), (0.1, None)])
def test_line_dedup_equals_brute_force(spark, ratio, most):
    texts = EDGE + corpus(5, 120) + ["same text\nfooter here"] * 30
    sources = [None if i % 10 == 0 else f"s{i % 2}" for i in range(len(texts))]
    docs = documents(spark, texts, sources)
    got = collected(line_dedup.dedup(docs, ratio=ratio, most=most), "doc_id")
    space = " \t\n\x0b\x0c\r"
    pages, holds = defaultdict(set), defaultdict(set)
    for t, s in zip(texts, sources):
        pages[s].add(t or "")
        for x in (t or "").split("\n"):
            holds[s, x.strip(space)].add(t or "")
    share = {k: len(v) / len(pages[k[0]]) for k, v in holds.items() if k[1]}
    drop = {k for k, x in share.items() if (len(holds[k]) >= 5 and x > ratio) or (most and len(holds[k]) >= 2 and x > most)}
    want = [t if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(space)) not in drop) for t, s in zip(texts, sources)]
    assert [None if x is None or x != x else x for x in got.text] == want and drop
    assert got.columns.tolist() == docs.columns
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    documents(spark, EDGE + corpus(6)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, corpus(6)[3]), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for query, sql in ((decontaminate.query, decontaminate.ORACLE), (mixing.query, mixing.oracle()), (quality_rules.query, quality_rules.ORACLE), (line_dedup.query, line_dedup.ORACLE)):
        df = query(spark, str(tmp_path))
        a = sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())))
        b = sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())))
        assert a == b


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    good = [" ".join(rng.choice(WORDS) for _ in range(60)).capitalize() + "." for _ in range(120)]
    junk = [" ".join(w + "###" for w in t.split()) for t in good[:40]]
    texts = [*good, *junk, good[3], good[5] + " more", good[7] + "\n" + item, None]
    docs = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    kept = {r.doc_id for r in now.collect()}
    assert {i for i in range(120)} - kept == set() and not kept & {160, 161, 162} and len(kept & set(range(120, 160))) <= 1
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= kept and 0.8 < sum(len(r.text.split()) for r in final if r.text) / (1.5 * 60 * 120) < 1.2
