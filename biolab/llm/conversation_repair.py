"""Repair of a conversation's structure at least cost, by dynamic programming over a trie of signatures.

Each turn becomes a letter: its role's initial (``s``, ``u``, ``a``, ``x`` for any other; upper case if its text is truncated), or
``d`` if it is blank or a duplicate and must go. A conversation's letters, from its last turn to its first, are its signature.
Signatures are range-partitioned and sorted, conversations of one signature with them (a common one is split by conv_id), and
each task walks its trie of them branch by branch: the costs of a node (what it takes to finish from each state of the
grammar ``(s?(ua)+)?``) are computed once for all signatures that share it, and a terminal node's branch, walked back to the root, gives the
cheapest edits in the order of the turns. Only the branch in hand is in memory, four numbers a node.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.
From each state only one of user and assistant is legal, so letters alone say what was done.

Turns of a conversation are in order of turn (null first), then role and text. Repairing and hashing stream over the sorted rows, so that a
conversation with a third of all turns takes one task long (its hash is one sequence) but no memory for its texts; its
signature and its audit, a byte a turn, are one string each.

Defined cases: null roles and texts are one space, as are nulls in the text that is hashed for damage; a null conv_id is a
conversation like any other; an empty role counts as another role; repeated rows are duplicates; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: What a truncated turn adds if it stays.
TRUNCATED = 1
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after system, after user, after assistant. The state that the next user or assistant leads to:
NEXT = (2, 2, 3, 2)
NAME = (None, None, "user", "assistant")
#: The state that a kept turn leads to, by (state, letter).
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: What it takes to finish behind the last turn.
END = (0, 2 * INSERT, INSERT, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): what a crc32 of ``conv_id:turn`` does to a row; dropped rows are ``gone``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    df = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("what") == 0).alias("gone"))


def intact(conversations: DataFrame) -> DataFrame:
    """The columns of ``damaged`` for conversations as they are."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", shown("role"), shown("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def turns(rows: DataFrame) -> DataFrame:
    """Adds to the columns of ``damaged``: pos (from 1, dropped rows last), fault (blank, duplicate, truncated or null), letter, illegal, new_turn.

    Dealt by conv_id once; both windows sort within that.
    """
    rows = rows.repartition(F.col("conv_id"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    copy_of = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn", "copy")
    rows = rows.withColumn("again", F.row_number().over(copy_of) > 1)
    fault = F.when(bare == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    order = Window.partitionBy("conv_id").orderBy("gone", F.asc_nulls_first("turn"), "role", "text", "copy")
    first = F.substring("role", 1, 1)
    letter = F.when(fault.isin("blank", "duplicate"), "d").otherwise(F.when(fault == "truncated", F.upper(first)).otherwise(first))
    letter = F.when(letter == "d", "d").when(first.isin("s", "u", "a"), letter).otherwise(F.when(fault == "truncated", "X").otherwise("x"))
    letter = F.when(fault.isin("blank", "duplicate"), "d").otherwise(letter)
    pair = F.concat(F.lag(first).over(order), first)
    before = F.lag("turn").over(order)
    return rows.select(
        "conv_id", "turn", "role", "text", "gone", F.row_number().over(order).alias("pos"), fault.alias("fault"), letter.alias("letter"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), (F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).alias("new_turn"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation, of rows as of ``turns``."""
    live = ~F.col("gone")
    turn = F.when(live, F.col("turn"))
    count = lambda c: F.count_if(live & F.coalesce(c, F.lit(False)))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new_turn")), F.lit(0))
    letters = F.reverse(F.sort_array(F.collect_list(F.when(live, F.struct("pos", "letter")))))
    return rows.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"),
    )


def _layer(letter: str, after: tuple) -> tuple:
    """Costs from before a turn to the end, by state, from those behind it."""
    low = letter.lower()
    stays = TRUNCATED if letter != low else 0
    out = [DELETE + c for c in after]
    if letter != "d":
        for s in range(4):
            to = KEPT.get((s, low))
            out[s] = min(out[s], REROLE + stays + after[NEXT[s]], out[s] if to is None else KEEP + stays + after[to])
    for _ in range(2):  # at most two insertions before a turn lead to every state that insertions reach
        for s in range(4):
            out[s] = min(out[s], INSERT + out[NEXT[s]])
    return tuple(out)


class Branch:
    """The branch of the trie that leads to the signature in hand, with the costs of each of its nodes."""

    def __init__(self):
        self.letters, self.costs = "", [END]

    def descend(self, signature: str) -> None:
        """Leaves the branch where the signature leaves it; only nodes behind that are new."""
        a, n = self.letters, min(len(self.letters), len(signature))
        if a[:n] != signature[:n]:
            low, high = 0, n  # the shared part, by halving
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if a[:mid] == signature[:mid] else (low, mid - 1)
            n = low
        del self.costs[n + 1 :]
        for letter in signature[n:]:
            self.costs.append(_layer(letter, self.costs[-1]))
        self.letters = signature

    def answer(self) -> tuple[int, str]:
        """(cost, audit) at the terminal node: of equally cheap edits the ASCII-least, D before I before K before R."""
        k, s, out = len(self.letters), 0, []
        total = self.costs[k][0]
        while True:
            cost = self.costs[k][s]
            if k and cost == DELETE + self.costs[k - 1][s]:
                k -= 1
                out.append("D")
            elif cost == INSERT + self.costs[k][NEXT[s]]:
                s = NEXT[s]
                out.append("I")
            elif not k:
                return total, "".join(out)
            else:
                low = self.letters[k - 1].lower()
                stays = TRUNCATED if self.letters[k - 1] != low else 0
                to = KEPT.get((s, low))
                k -= 1
                if low != "d" and to is not None and cost == KEEP + stays + self.costs[k][to]:
                    s = to
                    out.append("K")
                else:
                    s = NEXT[s]
                    out.append("R")


def audits(sigs: DataFrame) -> DataFrame:
    """Adds cost and audit. ``sigs`` (with conv_id and signature) is read twice: the first time for the ranges."""
    names, at = sigs.columns, sigs.columns.index("signature")

    def batches(rows):
        branch, of = Branch(), None
        for batch in rows:
            costs, out = [], []
            for signature in batch.column(at).to_pylist():
                if signature != branch.letters or of is None:
                    branch.descend(signature)
                    of = branch.answer()
                costs.append(of[0])
                out.append(of[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(out, pa.string())], names=[*names, "cost", "audit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sigs.schema)
    dealt = sigs.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return dealt.mapInArrow(batches, f"{kinds}, cost long, audit string")


def _edited(batches, audit: int, pos: int, role: int, text: int):
    """(batch, row, edit, role, text) for each edit of the sorted rows; first (batch, row, "", "", "") for a conversation's audit, whose pos is 0."""
    edits, at, s = "", 0, 0

    def inserted(batch, i):
        nonlocal at, s
        while at < len(edits) and edits[at] == "I":
            s, at = NEXT[s], at + 1
            yield batch, i, "I", NAME[s], ""

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (audit, pos, role, text)]
        for i, (a, p, r, t) in enumerate(zip(*cols)):
            if p == 0:
                edits, at, s = a, 0, 0
                yield batch, i, "", "", ""
                yield from inserted(batch, i)
                continue
            edit, at = edits[at], at + 1
            if edit == "K":
                s = KEPT[s, r[0]]
                yield batch, i, "K", r, t
            elif edit == "R":
                s = NEXT[s]
                yield batch, i, "R", NAME[s], t
            else:
                yield batch, i, "D", None, None
            yield from inserted(batch, i)


def _followed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order, in one partition."""
    texts = rows.filter("not gone").select("conv_id", "pos", "role", "text")
    both = plans.withColumn("pos", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "pos")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, in order of place from 0; deleted turns aren't in it."""
    df = _followed(rows, plans).select("conv_id", "audit", "pos", "role", "text")

    def out(batches):
        place, held, of = 0, [[] for _ in range(5)], None
        for batch, i, edit, role, text in _edited(batches, 1, 2, 3, 4):
            if not edit:
                place, of = 0, batch.column(0)[i].as_py()
            elif edit != "D":
                for c, x in zip(held, (of, place, edit, role, text)):
                    c.append(x)
                place += 1
                if len(held[0]) == 1000:
                    yield flush(held, batch.schema.field(0).type)
        if held[0]:
            yield flush(held, batch.schema.field(0).type)

    def flush(held, kind):
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "edit", "role", "text"])
        for c in held:
            c.clear()
        return b

    kind = rows.schema["conv_id"].dataType.simpleString()
    return df.mapInArrow(out, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with repaired_sha256 of each repaired conversation's ``role:text`` lines."""
    kept = [c for c in plans.columns if c != "signature"]
    df = _followed(rows, plans.select(*kept)).select(*kept, "pos", "role", "text")
    at = {c: i for i, c in enumerate(df.columns)}
    schema = ", ".join(f"{c} {plans.schema[c].dataType.simpleString()}" for c in kept) + ", repaired_sha256 string"

    def out(batches):
        done, hashes = [], []
        sha, empty = None, True

        def close():
            if sha is not None:
                hashes.append(sha.hexdigest())

        def flush():
            b = pa.Table.from_batches(done).append_column("repaired_sha256", pa.array(hashes, pa.string()))
            done.clear()
            hashes.clear()
            return b.to_batches()

        for batch, i, edit, role, text in _edited(batches, at["audit"], at["pos"], at["role"], at["text"]):
            if not edit:
                close()
                if len(done) >= 1000:
                    yield from flush()
                sha, empty = hashlib.sha256(), True
                done.append(batch.select(kept).slice(i, 1))
            elif edit != "D":
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        close()
        if done:
            yield from flush()

    return df.mapInArrow(out, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as of ``turns``, plans: signatures with cost and audit) of rows as of ``damaged`` or ``intact``."""
    scratch = Scratch(rows.sparkSession, "repair")
    found = scratch.put("turns", turns(rows))
    return found, scratch.put("plans", audits(scratch.put("signatures", signatures(found))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = digests(*repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _oracle() -> str:
    """DuckDB SQL for ``query``: costs and audits from the first turn on, in a recursive step for each turn."""
    more = lambda s, cost, letter: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}} END"
    when = lambda cond, x: f"CASE WHEN {cond} THEN {x} END"
    go = [[more(f"s{s}", DELETE, "D")] for s in range(4)]
    for (s, letter), to in KEPT.items():
        go[to].append(when(f"l = '{letter}'", more(f"s{s}", "t", "K")))
    for s, to in enumerate(NEXT):
        go[to].append(when("l <> 'd'", more(f"s{s}", f"{REROLE} + t", "R")))
    step = ", ".join(f"least({', '.join(x)}) AS g{s}" for s, x in enumerate(go))
    put = lambda s: more(s, INSERT, "I")
    byte = "lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::ubigint[]), lambda a, i: xor(a >> 1, 3988292384::ubigint * (a & 1)))"
    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy"
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(key, ''), lambda b: ascii(b)::ubigint)), {byte}), 4294967295::ubigint) % 20 AS what FROM named),
dmg AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
 FROM crc, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE what <> 0),
placed AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER ({order}) AS pos, left(role, 1) AS ini, lag(left(role, 1)) OVER ({order}) AS before,
 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dmg),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
letters AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END AS l, coalesce(fault = 'truncated', false)::int AS t FROM f),
dp AS (SELECT DISTINCT conv_id, 0::bigint AS pos, {{'c': 0, 'a': ''}} AS s0, NULL::struct(c integer, a varchar) AS s1, {{'c': {INSERT}, 'a': 'I'}} AS s2, {{'c': {2 * INSERT}, 'a': 'II'}} AS s3 FROM conversations
 UNION ALL SELECT conv_id, pos, g0, g1, h2, least(g3, {put('h2')}) FROM (SELECT *, least(g2, {put('g0')}, {put('g1')}, {put('g3')}) AS h2
 FROM (SELECT dp.conv_id, letters.pos, {step} FROM dp JOIN letters ON letters.conv_id = dp.conv_id AND letters.pos = dp.pos + 1))),
best AS (SELECT conv_id, least(s0, s3) AS r FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
edits AS (SELECT conv_id, i, substring(r.a, i, 1) AS e FROM best, unnest(range(1, len(r.a) + 1)) AS u(i)),
shown AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS pos, count(*) FILTER (e <> 'D') OVER w - 1 AS nth FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
met AS (SELECT s.*, CASE WHEN e <> 'I' THEN role END AS role, CASE WHEN e <> 'I' THEN text END AS text, max((e = 'K' AND s.nth = 0 AND ini = 's')::int) OVER (PARTITION BY s.conv_id) AS led
 FROM shown s LEFT JOIN placed p ON p.conv_id = s.conv_id AND p.pos = s.pos),
line AS (SELECT conv_id, i, CASE WHEN e = 'K' THEN role WHEN (nth - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM met WHERE e <> 'D'),
sha AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS repaired_sha256 FROM line GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
 r.c::bigint AS cost, r.a AS audit, coalesce(repaired_sha256, '{hashlib.sha256(b"").hexdigest()}') AS repaired_sha256 FROM best LEFT JOIN n USING (conv_id) LEFT JOIN sha USING (conv_id)"""


ORACLE = _oracle()
