"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds spans.

The fixed patterns (``base_spans``) are searched in each whole text. The CRF labels words O, EMAIL, IP,
CARD or PHONE; its features are shapes only (digit and letter counts, punctuation, the neighbours'
shapes), so it finds data in layouts the patterns don't have, such as phones without a country code or cards of 15 digits. It
is trained from a small labelled table by gradient ascent on the driver (a few dozen lines) and decoded
by Viterbi for all sequences of a batch at once. A chain is a whole line, whatever its length; neighbouring words of one label
make one span. Added cards pass Luhn, and added spans never overlap base spans.

A word whose score for O is over all others by more than two transitions can make up for is O in the best labelling, whatever
its neighbours are. The chain falls apart there without changing any label, and only the stretches between are decoded.

Defined cases: a null text is empty and has no spans; offsets are code points, ends are exclusive;
repeated rows give the same spans; a word of over 200 bytes is of no kind by itself; of labels that tie the first is taken; words of a very long text are handled slice by slice of
documents, a single text as a whole; an empty table gives an empty result; other columns are not read by ``find_pii`` and kept by
``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._joins import map_batches
from ._words import SPACE, slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: One labelled line each; data stand in brackets behind their kind.
LABELLED = (
    "please write to [email:jo.miller@clinic.example.org] about the new results",
    "mail [email:a_b-77@lab3.example.net] or visit the desk on monday",
    "sent by [email:results+east@mail.example.com] at noon",
    "contact: [email:x.y@example.co] for help",
    "the address [email:frontdesk@example-hospital.org] is read daily",
    "call [phone:+1 (202) 555-0147] before noon",
    "call [phone:(202) 555-0147] before noon",
    "phone [phone:(017) 555-7713] or come in person",
    "her number is [phone:202-555-0188] since may",
    "his number is [phone:555-201-0199] now",
    "fax [phone:+44 20 7946 0958] and mail",
    "ring [phone:(303) 555-9921] for the ward",
    "dial [phone:719-555-2210] and ask for the night desk",
    "mobile [phone:+49 30 901820] works",
    "server at [ip:192.168.12.7] answered",
    "the host [ip:10.20.30.41] was down",
    "from [ip:129.38.82.176] with love",
    "login from [ip:8.8.4.4] failed twice",
    "paid with [card:4111 1111 1111 1111] yesterday",
    "card [card:5500-0000-0000-0004] was declined",
    "number [card:4012 8888 8888 1881] is on file",
    "the account [card:3782-8224-6310-0055] expired in may",
    "card [card:4111111111111111] on file",
    "paid by [card:5105105105105100] on monday",
    "the number [card:6011000990139424] was declined twice",
    "she read out [card:4222222222222220] and hung up",
    "account [card:378282246310005] is closed",
    "visa [card:4917 6100 0000 0000] ends in june",
    "charge it to [card:371449635398431] please",
    "the old one is [card:3530.1113.3330.0000] by the list",
    "order 98079157628 was shipped on monday",
    "order 08109928472 was shipped late",
    "sample 4736 and sample 22 were lost",
    "in 2021 the ward had 312 beds and 45 nurses",
    "version 3.2.1 of the software was released",
    "the value 12.5 rose to 13.75 on friday",
    "on 2024-01-15 the visit ended at 10:30 in room 7",
    "between 10-12 and 14-16 there is no service",
    "the token 04dbebab91ab85687d33eeaaf9ac69 was revoked",
    "key = \"f962e1188\" is stored in the vault",
    "price $$$ and &&& of the ### item *** fell",
    "see page 12 (table 3) for the list of 1,204 items",
    "code ABC-123-XYZ and 77-B are on the box",
    "the ward and the desk are open, and the lab too.",
    "one | two | three | four | five",
    "All patients came back with the same answer to it.",
    "ratio 3/4 of 100% was met (see 5)",
    "id 123456789 belongs to lot 5512",
    "isbn 978-3-16-148410-0 is the book on the shelf",
    "license version 3 of 29 june 2007",
    "write to them @ the desk",
    "values 1.2.3.4.5.6 were skipped",
    "le patient est à la maison et il va bien",
    "der arzt hat die werte von 12 bis 14 uhr geprüft",
)


# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits starts: what follows the run decides, wherever in it one begins.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ has at most one match, from the start of the run before it: time is linear in the text."""
    out, at = [], 0
    p = text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, m.end()))
        at = m.end() if m else p + 1
        p = text.find("@", at)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS, each by start."""
    mail = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return [mail, [], [], []]
    ip = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = []
    if "+" in text:
        phone = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return [mail, ip, card, phone]


# ---------------------------------------------------------------- shapes

def _fields(*groups: bytes) -> np.ndarray:
    """A number for each byte whose 12-bit fields count the groups it is in; a word's fields add up."""
    out = np.zeros(256, np.int64)
    for i, group in enumerate(groups):
        out[list(group)] += 1 << (12 * i)
    return out


_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes([*range(97, 123), *range(128, 256)])
_ONE = _fields(_DIGITS, _UPPER + _LOWER, b".", b"-", b"@")
_TWO = _fields(b"+", b"()", b",;:!?\"'", _UPPER, bytes(sorted({*range(33, 127)} - {*_DIGITS, *_UPPER, *_LOWER, *b".-@+(),;:!?\"'"})))
#: Numbers of values of a word's own features: digits, make-up, dots, length.
SIZES = (14, 16, 5, 8)
#: A word's features: its own, and digits and make-up of the word before and the word after (one more value for none).
WIDTH = (*SIZES, SIZES[0] + 1, SIZES[1] + 1, SIZES[0] + 1, SIZES[1] + 1)
START = np.concatenate(([0], np.cumsum(WIDTH)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the texts."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' own features, an int16 column for each of SIZES."""

    def sums(table):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[ends] - total[starts]

    one, two = sums(_ONE), sums(_TWO)
    field = lambda x, i: (x >> (12 * i)) & 4095
    digits, letters, dots, hyphens, ats = (field(one, i) for i in range(5))
    plus, parens, marks, upper, other = (field(two, i) for i in range(5))
    length = np.minimum(ends - starts, 4000)
    bucket = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 11, 11, 11, 12])
    d = np.where(digits > 16, 13, bucket[np.minimum(digits, 16)])
    kind = np.full(len(starts), 15)
    for value, mask in (
        (14, (digits > 0) & (letters > 0)),
        (13, (digits > 0) & (letters == 0)),
        (12, (digits > 0) & (letters == 0) & (other == 0) & (hyphens > 0)),
        (11, (digits > 0) & (letters == 0) & (other == 0) & (dots > 0) & (hyphens == 0)),
        (10, (digits > 0) & (letters == 0) & (other == 0) & (parens == 2)),
        (9, (digits > 0) & (letters == 0) & (other == 0) & (parens == 1)),
        (8, (digits > 0) & (letters == 0) & (plus == 1)),
        (7, (digits > 0) & (digits + marks >= length) & (marks == 1)),
        (6, (digits > 0) & (digits == length)),
        (5, (digits == 0) & (letters > 0) & (upper == 0)),
        (4, (digits == 0) & (letters > 0) & (upper == 1)),
        (3, (digits == 0) & (letters > 0) & (upper > 1)),
        (2, (digits == 0) & (letters > 0) & (other > 0)),
        (1, (ats > 1) | ((ats == 1) & ((letters < 3) | (dots == 0)))),
        (0, (ats == 1) & (letters >= 3) & (dots > 0)),
    ):
        kind[mask] = value
    too_long = ends - starts > 200
    kind[too_long] = 15
    size = np.minimum(np.log2(length).astype(np.int64), 7)
    return np.stack([d, kind, np.minimum(dots, 4), size], 1).astype(np.int16)


def sequences(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the first word of every line."""
    lines = np.union1d(offsets, np.flatnonzero(data == 10))
    group = np.searchsorted(lines, starts, "right")
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(starts) else np.zeros(0, np.int64)


def emissions(own: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A score for each word and label."""
    n = len(own)
    head = np.zeros(n, bool)
    head[first] = True
    tail = np.roll(head, -1) if n else head
    score = np.zeros((n, weights.shape[1]), np.float32)
    for i in range(4):
        score += weights[START[i] + own[:, i]]
    for at, i in ((4, 0), (5, 1)):
        before = np.roll(own[:, i], 1)
        score += weights[START[at] + np.where(head, SIZES[i], before)]
        after = np.roll(own[:, i], -1)
        score += weights[START[at + 2] + np.where(tail, SIZES[i], after)]
    return score


def viterbi(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each word; all sequences go one step at a time, longest first."""
    n, k = score.shape
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    length = np.diff(np.concatenate((first, [n])))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    best, back = score[first], []
    for t in range(1, steps):
        m = alive[t]
        options = best[:m, :, None] + move
        came = options.argmax(1).astype(np.int8)
        now = np.take_along_axis(options, came[:, None, :].astype(np.int64), 1)[:, 0] + score[first[:m] + t]
        best[:m] = now
        back.append(came)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        labels[first[:m] + t] = state[:m]
        if t:
            state[:m] = back[t - 1][np.arange(m), state[:m]]
    return labels


def decoded(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each word of whole lines; only stretches between words that are O for certain go through Viterbi."""
    n = len(score)
    open_ = score[:, 0] - score[:, 1:].max(1) <= 2 * (move.max() - move.min()) + 1e-3
    labels = np.zeros(n, np.int8)
    head = np.zeros(n + 1, bool)
    head[first] = head[n] = True
    starts = np.flatnonzero(open_ & (head[:-1] | ~np.concatenate(([False], open_[:-1]))))
    ends = np.flatnonzero(open_ & (head[1:] | ~np.concatenate((open_[1:], [False])))) + 1
    # the certain words beside a stretch belong to its chain
    a, b = starts - ~head[starts], ends + ~head[ends]
    size = b - a
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    labels[at] = viterbi(score[at], np.cumsum(size) - size, move)
    return labels


# ---------------------------------------------------------------- training

_MARK = re.compile(r"\[(email|ip|card|phone):([^\]]*)\]")


def labelled_rows(lines=LABELLED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, [(start, end, label)]) of the marked lines."""
    out = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), 1 + KINDS.index(m[1])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def train(rows=None, steps: int = 300, rate: float = 0.1, decay: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves): maximum likelihood with an L2 penalty, by Adam on the exact gradient (forward-backward)."""
    rows = labelled_rows() if rows is None else rows
    data, offsets = text_bytes(pa.array([t for t, _ in rows], pa.string()))
    starts, ends = words(data, offsets)
    own, first = shapes(data, starts, ends), sequences(data, offsets, starts)
    gold = np.zeros(len(starts), int)
    for (text, spans), base in zip(rows, offsets):
        for s, e, label in spans:
            a, b = base + len(text[:s].encode()), base + len(text[:e].encode())
            gold[(starts < b) & (ends > a)] = label
    k, n = 1 + len(KINDS), len(starts)
    weights, move = np.zeros((START[-1], k)), np.zeros((k, k))
    index = np.zeros((n, len(WIDTH)), int)
    for i in range(len(WIDTH)):  # which weights a word uses: found by probing the scorer
        probe = np.zeros((START[-1], 1), np.float32)
        probe[START[i] : START[i + 1], 0] = np.arange(1, WIDTH[i] + 1)
        index[:, i] = START[i] + np.rint(emissions(own, first, probe)[:, 0]).astype(int) - 1
    length = np.diff(np.concatenate((first, [n])))
    grads = [np.zeros_like(weights), np.zeros_like(move)]
    seconds = [np.zeros_like(weights), np.zeros_like(move)]
    softmax = lambda x: (m := x.max(axis=-2, keepdims=True)) + np.log(np.exp(x - m).sum(axis=-2, keepdims=True))
    for step in range(1, steps + 1):
        score = weights[index].sum(1)
        gw, gm = np.zeros_like(weights), np.zeros_like(move)
        for f, size in zip(first, length):
            e = score[f : f + size]
            a, b = e.copy(), np.zeros_like(e)
            for t in range(1, size):
                a[t] = e[t] + softmax(a[t - 1][:, None] + move)[0]
            for t in range(size - 2, -1, -1):
                b[t] = softmax((move + (e[t + 1] + b[t + 1])[None, :]).T)[0]
            z = softmax(a[-1][:, None])[0, 0]
            p = np.exp(a + b - z)
            p[np.arange(size), gold[f : f + size]] -= 1
            for i in range(len(WIDTH)):
                np.add.at(gw, index[f : f + size, i], -p)
            for t in range(1, size):
                gm -= np.exp(a[t - 1][:, None] + move + (e[t] + b[t])[None, :] - z)
                gm[gold[f + t - 1], gold[f + t]] += 1
        for x, g, m1, m2 in ((weights, gw, grads[0], seconds[0]), (move, gm, grads[1], seconds[1])):
            g = g / len(first) - decay * x
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return weights.astype(np.float32), move.astype(np.float32)


# ---------------------------------------------------------------- operator

_EDGE = " \t.,;:!?\"'|"
_LEAST_DIGITS = {"ip": 4, "card": 13, "phone": 7}
_DROP = str.maketrans("", "", " -.")


def plausible(kind: str, s: str) -> bool:
    """What any datum of the kind has, whatever its layout."""
    digits = len(_DIGIT.findall(s))
    if kind == "email":
        return "@" in s.strip("@")
    if kind == "card":
        bare = s.translate(_DROP)
        return bare.isascii() and bare.isdigit() and _LEAST_DIGITS[kind] <= digits <= 19 and luhn(bare)
    return digits >= _LEAST_DIGITS[kind] and (kind != "phone" or digits <= 15)


def found(texts: pa.Array, weights: np.ndarray, move: np.ndarray):
    """For each text (base spans by kind, added spans by kind)."""
    data, offsets = text_bytes(texts)
    starts, ends = words(data, offsets)
    first = sequences(data, offsets, starts)
    labels = decoded(emissions(shapes(data, starts, ends), first, weights), first, move)
    marked = np.flatnonzero(labels)
    doc = np.searchsorted(offsets, starts[marked], "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        base = base_spans(text)
        more = [[], [], [], []]
        mine = marked[bounds[i] : bounds[i + 1]]
        if len(mine):
            raw = data[offsets[i] : offsets[i + 1]]
            a, b = starts[mine] - offsets[i], ends[mine] - offsets[i]
            breaks = np.cumsum(raw == 10) if len(mine) > 1 else None
            # a run goes on while the next word follows, has the same label and is on the same line
            new = np.append(True, (np.diff(mine) != 1) | (labels[mine][1:] != labels[mine][:-1]) | (breaks[a[1:]] != breaks[b[:-1] - 1])) if breaks is not None else np.array([True])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(mine)) - 1
            points = np.cumsum((raw & 0xC0) != 0x80)  # code points up to each byte
            spans = points[a[head]] - 1, points[b[tail] - 1]
            taken = sorted(s for spans in base for s in spans)
            reach = np.maximum.accumulate([e for _, e in taken]) if taken else None  # the furthest end of the first base spans
            before = np.searchsorted([s for s, _ in taken], spans[1]) if taken else None
            for j, (s, e) in enumerate(zip(*(x.tolist() for x in spans))):
                label = int(labels[mine[head[j]]]) - 1
                while s < e and text[s] in _EDGE:
                    s += 1
                while e > s and text[e - 1] in _EDGE:
                    e -= 1
                if s < e and plausible(KINDS[label], text[s:e]):
                    k = int(before[j]) if taken else 0
                    while k and taken[k - 1][0] >= e:  # the run's end moved back over marks
                        k -= 1
                    if not k or reach[k - 1] <= s:
                        more[label].append((s, e))
        yield base, more


def written(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, of in zip(KINDS, spans) for s, e in sorted(of))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


@cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train()


def find_pii(docs: DataFrame, labelled=None) -> DataFrame:
    """(doc_id, base counts by kind, base_sha256, spans, n_added) of every row. ``labelled``: rows as of ``labelled_rows``."""
    weights, move = train(labelled) if labelled else default_model()

    def batches(rows):
        for whole in rows:
            for batch in slices(whole, "text", 2 << 20):
                out = [[] for _ in range(7)]
                for base, more in found(batch.column(1), weights, move):
                    for c, spans in zip(out, base):
                        c.append(len(spans))
                    out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                    out[5].append(written([a + b for a, b in zip(base, more)]))
                    out[6].append(sum(map(len, more)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, f"doc_id {kind}, {SCHEMA}")


def redact(docs: DataFrame, labelled=None) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in angle brackets; null texts stay null."""
    weights, move = train(labelled) if labelled else default_model()
    where = docs.columns.index("text")

    def batches(rows):
        for whole in rows:
            for batch in slices(whole, f"c{where}", 2 << 20):
                texts = batch.column(where)
                out = []
                for text, (base, more) in zip(texts.to_pylist(), found(texts, weights, move)):
                    parts, at = [], 0
                    for s, e, kind in sorted((s, e, k) for k, a, b in zip(KINDS, base, more) for s, e in a + b):
                        if s >= at:
                            parts += [text[at:s], f"<{kind.upper()}>"]
                            at = e
                    out.append(text if text is None else "".join(parts) + text[at:])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == where else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_batches(docs, batches)


def query(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
