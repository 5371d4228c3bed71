"""Vectorised tokenising and hashing over Arrow string buffers.

Words and word shingles of a whole batch of texts are found and hashed with a few numpy passes over the UTF-8 bytes;
no Python loop runs per word. Hashes are 64 bits wide and depend on the bytes only, so every task agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are handled in slices of about so many bytes, so that memory doesn't follow the size of an Arrow batch.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = stream(64, 2) | U64(1)


def _blank(is_blank) -> np.ndarray:
    return np.array([is_blank(b) for b in range(256)], dtype=bool)


#: What parts words: ASCII white space, or all of ASCII but letters and digits.
WHITE = _blank(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
NOT_ALNUM = _blank(lambda b: b < 0x80 and not chr(b).isalnum())


class _Powers:
    """Powers of the base and of its inverse, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.ones(size, U64)
                done, step = 1, base
                while done < size:
                    np.multiply(out[:done], U64(step), out=out[done : 2 * done])
                    done, step = 2 * done, step * step % (1 << 64)
                setattr(self, name, out)
        return self.up, self.down


_powers = _Powers()


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts; text i is data[offsets[i]:offsets[i + 1]]. A null text is empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slices(self, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
        """The number of the first text of each slice, and the slice."""
        a = 0
        while a < len(self):
            b = int(np.searchsorted(self.offsets, self.offsets[a] + most, side="right")) - 1
            b = min(max(b, a + 1), len(self))
            yield a, Texts(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])
            a = b


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # number of the first word of each text, and of all words


def words(t: Texts, parts: np.ndarray = WHITE) -> Words:
    """Every maximal run of bytes that don't part words, in order."""
    n = len(t.data)
    if not n:
        empty = np.empty(0, np.int64)
        return Words(empty, empty, empty, np.empty(0, U64), np.zeros(len(t) + 1, np.int64))
    blank = parts[t.data]
    inner = t.offsets[(t.offsets > 0) & (t.offsets < n)]
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    before[inner] = True
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    after[inner - 1] = True
    start = np.flatnonzero(before & ~blank)
    end = np.flatnonzero(after & ~blank) + 1
    text = np.searchsorted(t.offsets, start, side="right") - 1
    with np.errstate(over="ignore"):
        up, down = _powers.upto(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[t.data] * up[:n], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * down[start])
    return Words(start, end, text, hashed, np.searchsorted(text, np.arange(len(t) + 1)))


def shingles(w: Words, n: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of n words. whole: a text of 1 to n - 1 words has one shingle, all its words."""
    with np.errstate(over="ignore"):
        count = max(0, len(w.hash) - n + 1)
        total = np.zeros(count, U64)
        for k in range(n):
            total += w.hash[k : k + count] * _STEPS[k]
        fits = w.text[:count] == w.text[n - 1 :] if count else np.empty(0, bool)
        found, owner = mix(total[fits] ^ U64(n)), w.text[:count][fits]
        if whole:
            sizes = np.diff(w.first)
            short = np.flatnonzero((sizes > 0) & (sizes < n))
            if len(short):
                extra = np.zeros(len(short), U64)
                for k in range(n - 1):
                    has = sizes[short] > k
                    extra[has] += w.hash[w.first[short[has]] + k] * _STEPS[k]
                found = np.concatenate([found, mix(extra ^ sizes[short].astype(U64))])
                owner = np.concatenate([owner, short])
                order = np.argsort(owner, kind="stable")
                found, owner = found[order], owner[order]
    return found, owner


def distinct(found: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, one after another, and where each text's begin."""
    at = np.searchsorted(owner, np.arange(texts + 1))
    sets = [np.unique(found[at[i] : at[i + 1]]) for i in range(texts)]
    ends = np.zeros(texts + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return (np.concatenate(sets) if sets else np.empty(0, U64)), ends
