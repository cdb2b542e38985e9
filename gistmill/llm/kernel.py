"""Vectorised text kernel: Arrow strings to word offsets and 64-bit word hashes.

Everything works on the UTF-8 bytes of a whole batch of texts, so no Python
object is made per word.  A word hash is a polynomial hash (wrapping 64-bit
arithmetic, odd base) of the A-Z-lowered bytes followed by a bijective mixer;
two different words share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 2 << 20
_SPAN = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[128:] = False
NOT_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, _SPAN + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One Arrow array of 64-bit-offset strings without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (relative to those bytes) of a large_string array."""
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(arr: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    at = 0
    while at < len(arr):
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(arr))
        yield at, end
        at = end


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs outside `gap`) and, by text, the
    range of its words: text i has words at[i]..at[i + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~gap[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    inner = off[1:-1]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] with A-Z lowered, in pieces of
    bounded size; `starts` must ascend."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        end = max(int(np.searchsorted(ends, lo + _SPAN, "right")), at + 1)
        hi = ends[end - 1]
        up, down = _power(int(hi - lo) + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum((LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = (total[e] - total[s]) * down[s]
        at = end
    return mix(out)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text's word hashes;
    a shorter text is one shingle, an empty one has none."""
    if not len(h):
        return h
    w = min(k, len(h))
    out = np.zeros(len(h) - w + 1, np.uint64)
    for j in range(w):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - w + 1 + j])
    return np.unique(out)


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def shingle_sets(arr: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, in order, what shingles() gives for its whitespace words."""
    for lo, hi in groups(arr, GROUP_BYTES // 4):
        data, off = buffers(arr.slice(lo, hi - lo))
        starts, ends, at = words(data, off)
        h = hashes(data, starts, ends)
        if len(h) >= k:
            runs = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                runs = mix(runs * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j])
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a < k:
                yield shingles(h[a:b], k)
                continue
            s = np.sort(runs[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]


class Lookup:
    """Membership in a sorted array of 64-bit hashes: a bit table, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        bits = min(25, max(20, len(keys).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x in the sorted keys, -1 where absent."""
        out = np.full(len(x), -1, np.int64)
        if len(self.keys):
            may = np.flatnonzero(self.table[(x >> self.shift).astype(np.int64)])
            pos = np.searchsorted(self.keys, x[may])
            ok = self.keys[np.minimum(pos, len(self.keys) - 1)] == x[may]
            out[may[ok]] = pos[ok]
        return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
