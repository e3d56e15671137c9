"""Words, shingles and byte hashes of Arrow string batches, vectorised in numpy.

Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r; A-Z are lower-cased. A word's
hash is a polynomial over its bytes modulo 2^64, mixed; it comes from one running sum over the bytes,
so no Python code runs per word.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each input bit changes half of the output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random number for each byte value.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER_BYTE = BYTE[LOWER]


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    return _powers(_BASE, 1 << max(16, (n - 1).bit_length()))


def inverse_powers(n: int) -> np.ndarray:
    return _powers(_INVERSE, 1 << max(16, (n - 1).bit_length()))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string array without copying what Arrow holds; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about PIECE bytes, cut at the starts of texts or else at white space; a word is never cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                white = np.flatnonzero(SPACE[data[at:end]])
                if len(white):
                    end = at + int(white[-1]) + 1
                else:  # a word longer than a piece
                    ahead = end
                    while ahead < n and not SPACE[data[ahead]] and ahead < offsets[k + 1]:
                        step = data[ahead : min(ahead + PIECE, int(offsets[k + 1]))]
                        white = np.flatnonzero(SPACE[step])
                        ahead += int(white[0]) if len(white) else len(step)
                        if len(white):
                            break
                    end = ahead
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, index of each text's first word, of len + 1)."""
    hashes, starts_all = [], []
    for a, b in _pieces(data, offsets):
        piece = data[a:b]
        n = len(piece)
        inside = ~SPACE[piece]
        edge = np.zeros(n + 1, bool)
        lo, hi = np.searchsorted(offsets, (a, b))
        edge[offsets[lo : hi + 1][offsets[lo : hi + 1] <= b] - a] = True
        edge[0] = edge[n] = True
        starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
        total = np.zeros(n + 1, U)
        np.cumsum(LOWER_BYTE[piece] * powers(n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse_powers(n)[starts]
        hashes.append(mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))
        starts_all.append(starts + a)
    if not hashes:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    h, starts = np.concatenate(hashes), np.concatenate(starts_all)
    return h, np.searchsorted(starts, offsets)


_K = mix(np.arange(101, 165, dtype=U))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, at every index where one starts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * (_K[0] | U(1))
    for j in range(1, size):
        out += h[j : j + n] * (_K[j] | U(1))
    return mix(out)


def shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text; all words as one where there are fewer than ``size``."""
    data, offsets = text_bytes(texts)
    h, first = word_hashes(data, offsets)
    grams = gram_hashes(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix(np.array([(h[a:b] * (_K[: b - a] | U(1))).sum() + U(b - a)], U))
        else:
            yield np.zeros(0, U)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in runs of rows of about ``limit`` bytes of text, so that working memory follows the limit or the longest text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    _, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
