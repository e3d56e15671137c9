import pandas as pd

#: Names that operators use or might use for columns of their own.
CLASHES = "_of _drop _mix _row _ROW_ _gone _page _copies _leak _salt a.b host h hs page item_id of part sets sketch at fill level kept score".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rep string, n long, size long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def documents(spark, texts, sources=None, ids=None):
    """A documents table with extra columns whose names clash with those that operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, len(t or ""), "x", 1, 2, *CLASHES) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, COLUMNS)


def collected(df, *keys):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns).sort_values(list(keys) or list(df.columns)[:1]).reset_index(drop=True)


WORDS = [f"w{i}" for i in range(400)]
EDGE = [None, "", "   \n\t ", "one", "A b C d", "the same five words here", "The SAME five words here", "x" * 5000, " ".join(WORDS * 20)]
