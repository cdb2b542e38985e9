"""Importance resampling towards a target text, from a document-by-bucket matrix.

Features of a text are its runs of one and two words, hashed into buckets by the
CRC-32 of their bytes.  The counts of a group of documents are one CSR block (row
bounds, bucket numbers, counts), and all blocks are written to the shared folder.
Column sums of the blocks give the corpus's distribution, the target's blocks its
own; a bucket's gain is the logarithm of their smoothed ratio.  The product of the
blocks with the vector of gains gives each document's weight, and the weight with a
Gumbel variate of the document's hash its score; the highest scores are drawn.

The CRC-32 of a pair of words is combined from those of its words (the CRC is linear:
appending n bytes is a fixed linear map of the register, four table lookups), so
text is read once and no feature is built as a string.

Scores are ranked where they lie after a shuffle by ranges.  The driver sees the
gains, one for each bucket.

Defined cases: a null or wordless text has no features and weight 0; a null doc_id
hashes as the empty word and comes before others in ties; repeated rows each count
and may each be drawn; extra columns are not touched; an empty corpus gives no rows,
an empty target gains that prefer rare buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import kernel
from gistmill.llm.common import small_batches, table
from gistmill.llm.order import ranked

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIECE_BYTES = 4 << 20
_SHORT = 128
_BLOCK = "docs array<long>, words binary, ptr binary, bucket binary, n binary"


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32, and for n = 0.._SHORT the map that n zero bytes make
    of each byte of the register: [n, byte of the register, its value]."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    maps = np.empty((_SHORT + 1, 4, 256), np.uint32)
    maps[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(_SHORT):
        maps[n + 1] = (maps[n] >> np.uint32(8)) ^ byte[maps[n] & np.uint32(255)]
    return byte, maps


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of the words and of the pairs of neighbours of some texts, the words'
    bounds by text, and the numbers of those words that begin a pair."""
    starts, ends, at = kernel.words(data, off, kernel.NOT_LETTER)
    size = ends - starts
    bounds = np.concatenate(([0], np.cumsum(size)))
    held = kernel.LOWER[data[~kernel.NOT_LETTER[data]]]
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(held)])
    coded = every.dictionary_encode()
    known = coded.dictionary.to_pylist()
    which = coded.indices.to_numpy().astype(np.int64)
    one = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[which]
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))[which]
    begins = np.ones(len(starts), bool)
    begins[at[1:][at[1:] > 0] - 1] = False
    a = np.flatnonzero(begins)
    crc, tail = one[a], size[a + 1] + 1
    maps = _crc_tables()[1]
    n = np.minimum(tail, _SHORT)
    two = maps[n, 0, crc & 255] ^ maps[n, 1, crc >> 8 & 255] ^ maps[n, 2, crc >> 16 & 255] ^ maps[n, 3, crc >> 24] ^ spaced[a + 1]
    for i in np.flatnonzero(tail > _SHORT):
        two[i] = zlib.crc32(b" " + known[which[a[i] + 1]], int(crc[i]))
    return one, two, at, a


def _long_counts(data: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Counts by bucket and the number of words of one long text, in pieces that end
    at a gap and begin with the last word of the piece before."""
    total, words, at, end, carried = np.zeros(buckets, np.int64), 0, 0, 0, False
    while end < len(data):
        end += PIECE_BYTES
        while end < len(data):
            gap = np.flatnonzero(kernel.NOT_LETTER[data[end : end + PIECE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE_BYTES
        end = min(end, len(data))
        one, two, _, _ = features(data[at:end], np.array([0, end - at]))
        new = one[1:] if carried else one
        total += np.bincount(np.concatenate((new, two)) % buckets, minlength=buckets)
        words += len(new)
        starts, _, _ = kernel.words(data[at:end], np.array([0, end - at]), kernel.NOT_LETTER)
        carried = len(starts) > 0
        at = at + int(starts[-1]) if carried else end
    return total, words


def counts(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of a large_string array with their CSR block: words of each row,
    row bounds, buckets and counts."""
    for lo, hi in kernel.groups(texts):
        data, off = kernel.buffers(texts.slice(lo, hi - lo))
        if hi - lo == 1 and len(data) > PIECE_BYTES:
            total, n = _long_counts(data, buckets)
            bucket = np.flatnonzero(total)
            yield lo, hi, np.array([n]), np.array([0, len(bucket)]), bucket, total[bucket]
            continue
        one, two, at, a = features(data, off)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        keys = np.concatenate((row * buckets + one % buckets, row[a] * buckets + two % buckets))
        keys, n = np.unique(keys, return_counts=True)
        yield lo, hi, np.diff(at), np.searchsorted(keys, np.arange(hi - lo + 1) * buckets), keys % buckets, n


def csr_blocks(docs: DataFrame, *, buckets: int = BUCKETS, label: str = "csr") -> DataFrame:
    """The document-by-bucket matrix: one row for each block of documents with docs
    (their ids), words, ptr (64-bit), bucket and n (32-bit), little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text = kernel.columns(batch, "doc_id", "text")
            ids = doc_id.to_pylist()
            for lo, hi, words, ptr, bucket, n in counts(kernel.strings(text), buckets):
                cells = [x.astype(t).tobytes() for x, t in ((words, "<i8"), (ptr, "<i8"), (bucket, "<u4"), (n, "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo:hi]], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)], names=["docs", "words", "ptr", "bucket", "n"])

    small_batches(docs.sparkSession)
    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK), label)


def column_sums(blocks: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """bucket, total: summed in each task first, so a task sends a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, n in zip(*(c.to_pylist() for c in kernel.columns(batch, "bucket", "n")), strict=True):
                np.add.at(total, np.frombuffer(bucket, "<u4"), np.frombuffer(n, "<u4"))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "total"])

    return blocks.select("bucket", "n").mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus's."""
    s, t = [0] * buckets, [0] * buckets
    for sums, into in ((corpus, s), (target, t)):
        for r in column_sums(sums, buckets=buckets).collect():  # at most one row a bucket
            into[r.bucket] = r.total
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log((b + 1.0) * (all_s + float(buckets)) / ((a + 1.0) * (all_t + float(buckets))))) for a, b in zip(s, t, strict=True)]


def weighed(blocks: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the product of the matrix with the gains,
    by features and floored."""
    vector = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ptr, bucket, n in zip(*(c.to_pylist() for c in kernel.columns(batch, "docs", "words", "ptr", "bucket", "n")), strict=True):
                ptr, n = np.frombuffer(ptr, "<i8"), np.frombuffer(n, "<u4").astype(np.int64)
                upto = np.concatenate(([0], np.cumsum(n)))
                sums = np.concatenate(([0], np.cumsum(n * vector[np.frombuffer(bucket, "<u4")])))
                size, total = upto[ptr[1:]] - upto[ptr[:-1]], sums[ptr[1:]] - sums[ptr[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.frombuffer(words, "<i8")), pa.array(size), pa.array(total // np.maximum(size, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1, null where not drawn) of every
    document; `target` has a column text."""
    blocks = csr_blocks(docs, buckets=buckets)
    aimed = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets=buckets, label="target")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = table(weighed(blocks, gains(blocks, aimed, buckets=buckets)).withColumn("score", F.col("weight") + noise), "scored")
    pool = ranked(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")])
    drawn = F.when(F.col("rank") < F.floor(F.col("rows") * percent / 100), F.col("rank") + 1)
    cols = ["doc_id", "n_features", "weight", "score"]
    return pool.select(*cols, drawn.alias("rank")).unionByName(scored.where(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank")))
