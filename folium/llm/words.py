"""Words of a batch of texts as byte ranges, found and hashed with numpy over the Arrow buffer.

Every word pattern used here is a set of bytes once the text is UTF-8 (all bytes of non-ASCII characters behave alike),
so a whole Arrow batch is split at once, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Bytes whose words are hashed at once.
HASHED = 262_144


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


class Words:
    """buf: the bytes (folded); starts, ends: byte ranges of words; first: index of each text's first word, and the total."""

    def __init__(self, texts: pa.Array, word: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        if fold is not None:
            buf = fold[buf]
        self.buf, self.at, size = buf, at, len(buf)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = word[buf]
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        cut = at[1:-1]
        before[cut[cut < size]] = False
        after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(here & ~before)
        self.ends = np.flatnonzero(here & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; worked out for HASHED bytes of words at once, so a long text takes no more than its words' hashes."""
        out, a = np.zeros(len(self.starts), U), 0
        with np.errstate(over="ignore"):
            while a < len(out):
                b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + HASHED, side="right")))
                lo, hi = int(self.starts[a]), int(self.ends[b - 1])
                begin, end = self.starts[a:b] - lo, self.ends[a:b] - lo
                sums = np.zeros(hi - lo + 1, U)
                np.cumsum(_BYTE[self.buf[lo:hi]] * powers(_BASE, hi - lo), out=sums[1:])
                h = (sums[end] - sums[begin]) * powers(_BASE_INV, hi - lo)[begin]
                out[a:b] = mix(h + (end - begin).astype(U) * _STEP[0])
                a = b
        return out

    def covered(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which bytes lie in the ranges, which do not overlap."""
        step = np.zeros(len(self.buf) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        return np.cumsum(step[:-1], dtype=np.int8).astype(bool)

    def column(self, ends: np.ndarray, buf: np.ndarray) -> pa.LargeStringArray:
        """The words, up to ends, as an Arrow column; buf: their bytes in place of the text's."""
        at = np.concatenate([[0], np.cumsum(ends - self.starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf[self.covered(self.starts, ends)])))

    def joined(self, kept: np.ndarray | None = None) -> list[bytes]:
        """Each text's kept words (all, if not told), joined by one space."""
        which = np.arange(len(self.starts)) if kept is None else np.flatnonzero(kept)
        doc = np.searchsorted(self.first, which, side="right") - 1
        step = np.zeros(len(self.buf) + 1, np.int8)
        step[self.starts[which]] += 1
        step[self.ends[which]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        gaps = self.ends[which[:-1]][doc[:-1] == doc[1:]]
        inside[gaps] = True
        out = self.buf.copy()
        out[gaps] = 0x20
        at = np.concatenate([[0], np.cumsum(inside)])[self.at]
        out = out[inside].tobytes()
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each place; places too near the end of h have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out = out * _STEP[seed] + h[j : n + j]
        return mix(out + U(k))


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the words lo .. hi-1 for each pair, of any length."""
    with np.errstate(over="ignore"):
        base = _STEP[seed]
        inv = U(pow(int(base), -1, 2**64))
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ base) * powers(base, len(h)), out=sums[1:])
        return mix((sums[hi] - sums[lo]) * powers(inv, len(h) + 1)[lo] + (hi - lo).astype(U) * base)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `size` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, cut = np.cumsum(sizes), 0
        while cut < batch.num_rows:
            done = total[cut - 1] if cut else 0
            end = max(cut + 1, int(np.searchsorted(total, done + size, side="right")))
            yield batch.slice(cut, end - cut)
            cut = end


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
