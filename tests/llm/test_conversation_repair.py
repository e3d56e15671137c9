"""Conversation repair against a search over all edits, and the query against its SQL."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from biolab.llm import conversation_repair as cr

from .helpers import CLASHES


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if what:
            new = (turn, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
            out += [(conv, new)] * (2 if what == 3 else 1)
    return out


def searched(turns):
    """(cost, audit, lines) by a best-first search over edits, no states but the roles so far."""
    legal = re.compile(r"(s?(ua)*u?|s?)\Z")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, lines
        if (at, initials[-1:], bool(initials)) in done:
            continue
        done.add((at, initials[-1:], bool(initials)))
        go = lambda c, e, n, r, t: legal.match(initials + r[:1]) and heapq.heappush(heap, (cost + c, audit + e, n, initials + r[:1], (*lines, f"{r}:{t}")))
        for r in ("user", "assistant"):
            go(2, "I", at, r, "")
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    go(fault == "truncated", "K", at + 1, role, text)
                for r in ("user", "assistant"):
                    go(2 + (fault == "truncated"), "R", at + 1, r, text)


def brute(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[0]]
    for conv, new in damage(rows):
        of[conv].append(new)
    out = []
    for conv, turns in of.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, judged = set(), []
        for turn, role, text in turns:
            bare = text.rstrip(cr.SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = searched(judged)
        count = lambda f: sum(x[2] == f for x in judged)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, rng.choice(["Hi.", "Hi.", "what", " \n\t", "", None, "Well!\r\n", "é?", "no end 漢", "a: b\nc."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in [*CLASHES, "pos", "copy", "audit", "fault"])


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASHES, "p", "c", "a", "f") for r in rows], SCHEMA)


def result(spark, rows):
    df = cr.digests(*cr.repair(cr.damaged(table(spark, rows))))
    cols = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = corpus(seed)
    rows += [(None, 1, "user", "x."), (None, None, "assistant", None)] + [(1000, 0, "user", "Same.")] * 5 + [(1001, t, "user", "y" * 300_000 + ".") for t in range(3)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, corpus(1)[:1])[:0] == [] and cr.digests(*cr.repair(cr.damaged(table(spark, corpus(1)[:1]).limit(0)))).count() == 0


def test_one_long_conversation(spark):
    """Thousands of turns, most of them of one conversation: costs go by layers, so no step is quadratic."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", ""])) for t in range(20_000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = {r[0]: r for r in result(spark, rows)}
    edits = got[1][7]
    assert len(edits.replace("I", "")) == len(damage(r for r in rows if r[0] == 1))
    assert sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in edits) <= got[1][6]


def test_repaired_conversations_are_legal_and_match_the_digest(spark):
    rows = corpus(5, 80)
    found, plans = cr.repair(cr.intact(table(spark, rows)))
    of = defaultdict(list)
    for r in cr.repaired(found, plans).collect():
        of[r.conv_id].append(r)
    for r in cr.digests(found, plans).collect():
        turns = sorted(of[r.conv_id], key=lambda x: x.place)
        assert [t.place for t in turns] == list(range(len(turns))) and re.fullmatch(r"(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256
        assert [t.edit for t in turns] == [e for e in r.audit if e != "D"]


def test_shared_prefixes_are_computed_once(monkeypatch):
    made = []
    plain = cr._layer
    monkeypatch.setattr(cr, "_layer", lambda *a: made.append(1) or plain(*a))
    branch = cr.Branch()
    for s in ["", "auau", "auaus", "auaus", "auax", "d"]:
        branch.descend(s)
    assert len(made) == 4 + 1 + 1 + 1
    branch.descend("auau")
    assert branch.answer() == (0, "KKKK")


def test_sql_agrees(spark):
    rows = [r for r in corpus(9, 200) if r[1] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({cr.ORACLE}) ORDER BY conv_id").fetchall()
    assert result(spark, rows) == want
