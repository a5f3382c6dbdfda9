"""Vectorised word and byte kernels shared by the corpus operators.

All kernels work on the raw UTF-8 buffers of Arrow string columns, so no Python
string is made per row.  A *word* is a maximal run of ASCII letters and digits and
of non-ASCII characters; ASCII punctuation, white space, U+0080-U+00BF and
U+2000-U+203F separate words.  Case is folded for ASCII and for letters of two bytes whose
lower case has two bytes too (Latin, Greek, Cyrillic, Armenian), which keeps the byte
length, so word positions are byte positions of the source.  For texts in these scripts
the same rule in SQL is ``WORD_SQL`` applied to ``lower(text)``.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
WORD_SQL = r"[a-z0-9\x{C0}-\x{1FFF}\x{2040}-\x{10FFFF}]+"
CHUNK_BYTES = 1 << 19

_LUT = np.zeros(256, np.uint8)
for _b in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LUT[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LUT[_b] = _b + 32
_LUT[0x80:] = np.arange(0x80, 0x100, dtype=np.uint8)

# Lower case of code points of two bytes, where it has two bytes as well.
_LOWER = np.arange(0x800, dtype=np.uint16)
for _c in range(0x100, 0x800):
    _l = chr(_c).lower()
    if len(_l) == 1 and 0x80 <= ord(_l) < 0x800:
        _LOWER[_c] = ord(_l)

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        for out, base in ((0, BASE), (1, U64(pow(int(BASE), -1, 1 << 64)))):
            a = np.full(size, base, U64)
            a[0] = 1
            a = np.multiply.accumulate(a)
            if out:
                _inv = a
            else:
                _pow = a
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_trimmed = 0.0


def release() -> None:
    """Give freed memory back to the system, every half second at most: the C library keeps what the kernels' arrays took, in each worker."""
    global _trimmed
    if time.monotonic() - _trimmed > 0.5:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)
        _trimmed = time.monotonic()


def chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (lo, hi, bytes, offsets) of about `target` bytes; a longer text is one range of its own."""
    raw, offs = strings(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + target, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes of the same length, 0 where a byte separates words."""
    f = _LUT[raw]
    for lead in (0xC3, 0xC2, 0xE2):
        i = np.flatnonzero(f == lead)
        if not len(i):
            continue
        if lead == 0xC3:
            nxt = f[i + 1]
            up = i[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
            f[up] += 0x20
        elif lead == 0xC2:
            f[i] = 0
            f[i + 1] = 0
        else:
            i = i[f[i + 1] == 0x80]
            f[i] = 0
            f[i + 1] = 0
            f[i + 2] = 0
    i = np.flatnonzero((f >= 0xC4) & (f < 0xE0))
    if len(i):
        low = _LOWER[(f[i].astype(np.uint16) & 0x1F) << 6 | f[i + 1] & 0x3F]
        f[i] = 0xC0 | low >> 6
        f[i + 1] = 0x80 | low & 0x3F
    return f


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # one past its last byte
    hash: np.ndarray  # 64-bit hash of the folded word
    first: np.ndarray  # for each text the index of its first word, and the count at the end
    sums: np.ndarray  # prefix sums from which the hash of any byte range follows
    folded: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefix_hash(self, which: np.ndarray, length: int) -> np.ndarray:
        """Hash of the first `length` bytes of the words `which` (each longer), other than that of a whole word."""
        _, inv = powers(len(self.sums))
        s = self.start[which]
        return mix((self.sums[s + length] - self.sums[s]) * inv[s] + U64((1 << 32) + length))


def words(raw: np.ndarray, offs: np.ndarray) -> Words:
    f = fold(raw)
    n = len(f)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, U64), np.zeros(len(offs), np.int64), np.zeros(1, U64), f)
    m = f != 0
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    inner = offs[:-1][np.diff(offs) > 0]
    st[inner] = m[inner]
    en[inner[1:] - 1] = m[inner[1:] - 1]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    pw, inv = powers(n + 1)
    v = f.astype(U64)
    v += U64(1)
    v *= pw[:n]
    sums = np.zeros(n + 1, U64)
    np.cumsum(v, out=sums[1:])
    h = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U64))
    return Words(s, e, h, np.searchsorted(s, offs), sums, f)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (ignoring where texts end)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the runs of `grams`: those which lie in one text."""
    ok = np.ones(max(0, n - k + 1), bool)
    if len(ok):
        for cut in range(1, k):
            at = first[1:-1] - cut
            ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values within each segment; 0 for an empty one."""
    c = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]


def normal_text(f: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts as ' w1 w2 ... wn ' joined by newlines, from folded bytes."""
    n = len(offs) - 1
    # Each text gets two separators in front: the newline and the opening space.
    out_len = len(f) + 3 * n
    at = np.arange(len(f)) + 2 + 3 * np.repeat(np.arange(n), np.diff(offs)) if len(f) else np.zeros(0, np.int64)
    buf = np.zeros(out_len, np.uint8)
    buf[at] = f
    heads = offs[:-1] + 3 * np.arange(n)
    keep = buf != 0
    spaces = np.zeros(out_len, bool)
    spaces[1:] = ~keep[1:] & keep[:-1]
    spaces[heads + 1] = True
    spaces[heads] = False
    buf[spaces] = 32
    # An empty text is ' ', any other ends in one space by the rule above.
    drop_second = heads + 2
    inside = drop_second < out_len
    spaces[drop_second[inside]] &= keep[drop_second[inside] - 1]
    buf[heads] = 10
    keep |= spaces
    keep[heads] = True
    return buf[keep]
