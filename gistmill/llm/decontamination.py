"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit distance.

Texts and items are normalised to words (runs of letters and digits, A-Z lowered;
equal 64-bit hashes count as equal words).  A text holds an item when the least edit
distance, in words, between the item and any stretch of the text is at most
floor(max_edit * words of the item).

A CGK walk maps a sequence of words to a sequence of as many steps as it takes: each
step gives the word it stands on and goes on by a bit that hangs on step and word,
so that sequences a few edits apart come to agree in most steps (a small Hamming
distance).  Segments of an item, of SEGMENT words or the next lower power of two,
cover all of its words; from each, and from each place of each text, `walks` walks
start.  Bit sampling takes SAMPLES steps of a walk as a key, REPEATS times; where two shared keys put the
start of an item within the limit of each other, there is a candidate.  The
number of walks is planned: the least whose keys find `target_recall` of copies at the
very limit, scattered or gathered, in a simulation by this same code.

Candidates of an item that overlap are verified once, exactly: counts of words that
the stretch and the item share or lack (each edit spoils one at most), then a bit-parallel automaton on
whole-number arithmetic.  The distance given is the least over the whole text.

Cost: a text is read once, without a shuffle, for each block of at most
BLOCK_ITEMS items and BLOCK_BYTES bytes; only such a block is ever broadcast, and
all blocks are gone through.

Defined cases: null or empty texts and items without a letter or digit hold or
are nothing; an item under 1 / max_edit words is held only unchanged; repeated items
are each reported; repeated rows are each judged, and give one finding for an id; a
null doc_id gives a finding with a null id; extra columns stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches, table
from gistmill.llm.kernel import NOT_LETTER, Lookup, buffers, columns, groups, hashes, mix, strings, words

MAX_EDIT = 0.1
TARGET_RECALL = 0.95
SEGMENT = 32
SAMPLES = 3
REPEATS = 3
MOST_WALKS = 12
GROUP_BYTES = 256 << 10
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def infix_distance(item: Sequence, text: Sequence, most: int) -> int | None:
    """Least edit distance of item to any stretch of text, None if over `most`."""
    m = len(item)
    if not m:
        return 0
    masks: dict = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus = minus | (full & ~(d0 | plus))
        h_minus = plus & d0
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        if score < best:
            best = score
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(d0 | h_plus))
        minus = h_plus & d0
    return best if best <= most else None


def segments(m: int) -> tuple[int, list[int]]:
    """(length, starts) of the segments that cover an item of m words."""
    size = min(SEGMENT, 1 << (m.bit_length() - 1))
    return size, sorted({*range(0, m - size + 1, size), m - size})


@lru_cache(maxsize=None)
def sampled(size: int, walk: int, repeat: int) -> tuple[int, ...]:
    """The steps that a repeat samples from a walk over a segment."""
    return tuple(sorted(np.random.default_rng((size, walk, repeat)).choice(size, min(SAMPLES, size), replace=False).tolist()))


def walk_keys(h: np.ndarray, sizes: Sequence[int], walk: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, keys from each place) of one walk over word hashes, a key for each repeat;
    zeros follow the last word."""
    longest = max(sizes, default=0)
    wanted = {s for size in sizes for r in range(REPEATS) for s in sampled(size, walk, r)}
    padded = np.concatenate([h, np.zeros(longest + 1, np.uint64)])
    bits = mix(padded * (_ODD ^ np.uint64(2 * walk + 2)) + np.uint64(walk + 1))
    at, met = np.arange(len(h)), {}
    for step in range(longest):
        if step in wanted:
            met[step] = padded[at]
        at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
    for size in sizes:
        for r in range(REPEATS):
            key = np.full(len(h), (walk * REPEATS + r) * SEGMENT + size, np.uint64)
            for step in sampled(size, walk, r):
                key += met[step]
                key *= _ODD
            key ^= key >> np.uint64(32)
            yield size, key * _ODD


class Index:
    """Keys of a block of items, and the search of texts."""

    def __init__(self, items: list[tuple], max_edit: float, walks: int):
        arr = strings(pa.array([t for _, t in items], pa.string()))
        data, off = buffers(arr)
        starts, ends, at = words(data, off, NOT_LETTER)
        h = hashes(data, starts, ends)
        self._build([(item_id, h[at[i] : at[i + 1]]) for i, (item_id, _) in enumerate(items)], max_edit, walks)

    def _build(self, items: list[tuple], max_edit: float, walks: int) -> None:
        self.walks = walks
        self.items: list[tuple] = []
        parts: dict[int, list[tuple]] = defaultdict(list)
        for item_id, own in items:
            if not len(own):
                continue
            size, begins = segments(len(own))
            parts[size] += [(own[b : b + size], len(self.items), b) for b in begins]
            self.items.append((item_id, own.tolist(), int(max_edit * len(own))))
        self.most = np.array([i[2] for i in self.items], np.int64)
        self.length = np.array([len(i[1]) for i in self.items], np.int64)
        # an item and one of its words as one number
        own = [np.unique(np.array(w, np.uint64)) for _, w, _ in self.items]
        self.held = Lookup(self._pair(np.repeat(np.arange(len(own)), [len(w) for w in own]), np.concatenate([np.zeros(0, np.uint64), *own])))
        self.by_size = {}
        for size, some in parts.items():
            flat = np.concatenate([p for p, _, _ in some])
            found = np.concatenate([k[::size] for w in range(walks) for _, k in walk_keys(flat, [size], w)])
            owner, begin = (np.tile([p[i] for p in some], walks * REPEATS) for i in (1, 2))
            order = np.argsort(found, kind="stable")
            lookup = Lookup(np.unique(found))
            first, last = (np.searchsorted(found[order], lookup.keys, side) for side in ("left", "right"))
            self.by_size[size] = lookup, first, last, owner[order], begin[order]

    @staticmethod
    def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + item.astype(np.uint64) * _ODD)

    def _full(self, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether as many words of a stretch are words of the item as a copy needs."""
        n = hi - lo
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        owner = np.repeat(np.arange(len(item)), n)
        own = self.held.find(self._pair(item[owner], h[where])) >= 0
        return np.bincount(owner[own], minlength=len(item)) >= (self.length - self.most)[item]

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start), in order: where two keys or more put an item's start."""
        item, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for walk in range(self.walks):
            for size, key in walk_keys(h, list(self.by_size), walk):
                lookup, first, last, owner, begin = self.by_size[size]
                hit = lookup.find(key)
                place = np.flatnonzero(hit >= 0)
                a, n = first[hit[place]], last[hit[place]] - first[hit[place]]
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                item.append(owner[each])
                start.append(np.repeat(place, n) - begin[each])
        item, start = np.concatenate(item), np.concatenate(start)
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        close = (item[1:] == item[:-1]) & (np.diff(start) <= self.most[item[1:]])
        keep = np.zeros(len(item), bool)
        keep[1:] |= close
        keep[:-1] |= close
        return item[keep], start[keep]

    def find(self, arr: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item number, distance) of a group of texts: the least distance of
        each item that a text holds."""
        if not self.items:
            return
        data, off = buffers(arr)
        starts, ends, at = words(data, off, NOT_LETTER)
        h = hashes(data, starts, ends)
        if not len(h):
            return
        item, start = self.candidates(h)
        lo, hi = start - self.most[item], start + self.length[item] + self.most[item]
        # one stretch of text for candidates of an item that overlap
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        cut = np.flatnonzero(new)
        item, lo, hi = item[cut], np.maximum(lo[cut], 0), np.minimum(hi[np.append(cut[1:], len(item)) - 1] if len(item) else hi, len(h))
        full = self._full(h, item, lo, hi)
        seen: set[tuple[int, int]] = set()
        for i, a, b in zip(item[full].tolist(), lo[full].tolist(), hi[full].tolist(), strict=True):
            _, own, most = self.items[i]
            row = max(int(np.searchsorted(at, a, "right")) - 1, 0)
            while row < len(at) - 1 and at[row] < b:
                near = h[max(a, at[row]) : max(0, min(b, at[row + 1]))].tolist()
                row += 1
                if (row - 1, i) in seen or len(near) < len(own) - most:
                    continue
                held = set(near)
                if sum(w not in held for w in own) > most or infix_distance(own, near, most) is None:
                    continue
                seen.add((row - 1, i))
                yield row - 1, i, infix_distance(own, h[at[row - 1] : at[row]].tolist(), most)


def recall(max_edit: float, walks: int, *, trials: int = 120) -> float:
    """The least share, over some lengths and both places of edits, of copies at the
    limit whose keys meet."""
    rng, least = np.random.default_rng(walks), 1.0
    fresh = lambda n: mix(rng.integers(1, 1 << 62, n).astype(np.uint64))
    for m in (5, 10, 15, 20, 31, 32, 45, 63, 100):
        most = int(max_edit * m)
        for gathered in (False, True):
            copies, items, at = [], [], []
            for _ in range(trials):
                own = fresh(m)
                places = np.arange(most) + rng.integers(0, m - most + 1) if gathered else rng.permutation(m)[:most]
                parts = np.split(own, np.sort(places))
                for j in range(most):  # change, drop or add a word
                    kind = rng.integers(0, 3)
                    parts[j + 1] = np.concatenate([fresh(int(kind != 1)), parts[j + 1][int(kind != 2) :]])
                at.append(sum(map(len, copies)) + SEGMENT)
                copies += [fresh(SEGMENT), *parts]
                items.append((0, own))
            index = Index.__new__(Index)
            index._build(items, max_edit, walks)
            item, start = index.candidates(np.concatenate([*copies, fresh(SEGMENT)]))
            met = np.abs(start - np.array(at)[item]) <= most
            least = min(least, len(np.unique(item[met])) / trials)
    return least


@lru_cache(maxsize=None)
def planned_walks(max_edit: float, target_recall: float) -> int:
    """The least number of walks that reaches the target, MOST_WALKS at most."""
    return next((w for w in range(1, MOST_WALKS) if recall(max_edit, w) >= target_recall), MOST_WALKS)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(block, max_edit: float, walks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block.value, max_edit, walks)
        for batch in batches:
            ids, text = columns(batch, "doc_id", "text")
            arr = strings(text)
            rows, items, dist = [], [], []
            for lo, hi in groups(arr, GROUP_BYTES):
                for row, item, d in index.find(arr.slice(lo, hi - lo)):
                    rows.append(lo + row)
                    items.append(index.items[item][0])
                    dist.append(d)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(dist, pa.int32())], ["doc_id", "item_id", "distance"])

    return run


def findings(docs: DataFrame, items: DataFrame, *, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, item_id, distance: which text holds which item, at its least distance in words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, distance int")
    walks = planned_walks(max_edit, target_recall)
    for block in _blocks(items):
        some = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), max_edit, walks), out.schema)
        out = out.unionByName(table(some, "findings"))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _clean(block, max_edit: float, walks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block.value, max_edit, walks)
        for batch in batches:
            arr = strings(batch.column(batch.schema.get_field_index("text")))
            keep = np.ones(len(arr), bool)
            for lo, hi in groups(arr, GROUP_BYTES):
                for row, _, _ in index.find(arr.slice(lo, hi - lo)):
                    keep[lo + row] = False
            yield batch.filter(pa.array(keep))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, *, max_edit: float = MAX_EDIT, target_recall: float = TARGET_RECALL) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    small_batches(docs.sparkSession)
    walks = planned_walks(max_edit, target_recall)
    for block in _blocks(items):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), max_edit, walks), docs.schema)
    return docs
