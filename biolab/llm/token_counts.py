"""Token counts of a byte-level BPE, by the whole-token shortcut.

Before a job, on the driver, every vocabulary string is run through the merges; those that come out as one token
are proven whole, and the proven table (at most the vocabulary, some 0.5 MB) is broadcast. A text is cut into pre-tokens by the tokenizer's own pattern; a pre-token that is a
proven string counts one, and only the rest is merged, with a bounded cache. Nothing is truncated or
padded; strings of added tokens inside a text count as the one token the library makes of them.

Defined cases: a null text is empty and has 0 tokens; texts of any length are cut at spaces between
letters, where a pre-token always starts; repeated rows are counted alike; merges that tie in rank go from the left; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices, text_bytes

LIMIT = 512
CACHE = 500_000
PIECE = 1 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token longer than this is merged without being cached.
CACHED_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def decoded(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class Counter(dict):
    """Pre-token -> number of tokens; missing ones are merged and kept up to a bound."""

    def __init__(self, path: str, proven: list[str] | None = None):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        kind = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or model.get("normalizer"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.rank = {}
        for i, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(left), raw(right)] = i
        added = {x["content"] for x in model.get("added_tokens", [])}
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        if proven is None:
            texts = ((s, decoded(raw(s))) for s in model["model"]["vocab"] if s not in added)
            proven = [t for s, t in texts if t is not None and self.merged(raw(s)) == 1]
        self.proven = dict.fromkeys(proven, 1)
        self.update(self.proven)
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")

    def merged(self, word: bytes) -> int:
        """Number of tokens after all merges, lowest rank first and leftmost among equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 400:
            return self.merged_long(parts)
        rank = self.rank.get
        none = len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return len(parts)

    def merged_long(self, parts: list[bytes]) -> int:
        """The same with a heap and linked neighbours, for very long pre-tokens."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
            if (k := after[i]) < n and (r := rank((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        return left

    def __missing__(self, token: str) -> int:
        n = self.merged(token.encode())
        if len(token) <= CACHED_CHARS:
            if len(self) > len(self.proven) + CACHE:
                self.clear()
                self.update(self.proven)
            self[token] = n
        return n

    def pieces(self, text: str):
        at = 0
        while len(text) - at > PIECE:
            m = self.cut.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def count(self, text: str) -> int:
        n = 0
        if self.added is not None and (found := self.added.findall(text)):
            parts, n = self.added.split(text), len(found)
        else:
            parts = [text]
        get, split = self.__getitem__, self.split
        for part in parts:
            for piece in self.pieces(part):
                n += sum(map(get, split(piece)))
        return n


@cache
def proven_table(path: str) -> list[str]:
    """The vocabulary strings that encode alone as one token."""
    return list(Counter(path).proven)


_counters: dict[str, Counter] = {}


def counter(path: str, proven) -> Counter:
    """A process's counter; ``proven`` is the broadcast table."""
    if path not in _counters:
        _counters[path] = Counter(path, proven.value)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). ``path`` is where the vocabulary file is on the driver and every machine."""

    proven = docs.sparkSession.sparkContext.broadcast(proven_table(path))

    def batches(rows):
        count = counter(path, proven).count
        for whole in rows:
            for batch in slices(whole, "text"):
                _, offsets = text_bytes(batch.column(1))
                n = np.array([count(t) for t in batch.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
