"""The pipeline's line stage on small hosts and on lines of under a tenth of a host's pages."""

import random
from collections import Counter

import corpus_pipeline

from .helpers import CLASHES, WORDS, collected, documents


def test_lines_of_small_hosts_and_rarer_footers_go(spark):
    pages = {"four": 4, "two": 2, "one": 1, "three": 3, None: 3}
    texts, sources, want = [], [], []
    for host, n in pages.items():
        for i in range(n):
            often = "on one" if host == "three" and i else "footer"
            body = f"{host} page {i}" if host != "three" or i != 1 else "body\non one only"
            texts.append(f"{body}\n{often}")
            sources.append(host)
            want.append(texts[-1] if host == "one" or (host == "three" and not i) else body)
    for i in range(200):
        texts.append(f"big page {i}" + "\nat eight percent" * (i < 16) + "\nat four percent" * (20 <= i < 28))
        sources.append("big")
        want.append(texts[-1].replace("\nat eight percent", ""))
    got = collected(corpus_pipeline.lines(spark, documents(spark, texts, sources), ""), "doc_id")
    assert got.text.tolist() == want
    assert got.n_chars.tolist() == [len(t) for t in want]


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(WORDS[50:90])), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_nulls_repeats_ties_long_texts_and_clashing_names(spark, tmp_path):
    rng = random.Random(6)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(w + "###" for w in t.split()) for t in good[:30]]
    long = " ".join(rng.choice(WORDS) for _ in range(500_000)) + " " + " ".join(WORDS[50:90])  # over a piece, the item at its end
    texts = [*good, *junk, good[3], good[3], None, "", long, good[9], good[9]]
    ids = [*range(90), 3, 90, 91, 92, 93, 94, 94]  # a repeated row, copies, and a copy that is repeated
    docs = documents(spark, texts, [None if i % 7 == 0 else f"s{i % 3}" for i in range(len(texts))], ids)
    tables(spark, tmp_path, docs, [(i, int(i < 60), None if i % 2 else 0) for i in range(90)] + [(None, 1, 0), (95, None, 0)])
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns[: len(docs.columns)] == docs.columns, name
        assert [now.first()[c] for c in CLASHES] == CLASHES, name
        seen[name] = Counter(r.doc_id for r in now.collect())
    assert set(range(60)) <= set(seen["quality"]) and len(set(range(60, 90)) & set(seen["quality"])) <= 2
    assert seen["quality"][3] == 2 and seen["quality"][94] == 2 and seen["lines"] == seen["quality"]
    assert seen["near"][3] == 2 and not {90, 94} & set(seen["near"]) and set(range(60)) <= set(seen["near"])
    assert 93 not in seen["leaks"] and {k: n for k, n in seen["near"].items() if k != 93} == dict(seen["leaks"])
    assert set(seen["mixed"]) <= set(seen["leaks"])


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, ["a b c d e f"])
    tables(spark, tmp_path, docs.limit(0), [(0, 1, 0), (1, 0, 0)])
    now = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
