"""Packing token ids into sequences: concatenate and cut.

Each task tokenises its part of the documents and writes the ids with their place
in the part (first pass of the prefix sums).  The parts' totals, summed up in two
levels, give each part its place in one long stream (second pass).  The stream is
cut into fixed windows of `width` ids; a document that crosses a window's end gives
a piece, with its boundary record (start, length, sequence, offset), on each side.
Only the last window is short, so a corpus is padded by less than one window.

Ids are those of the tokenizer for the whole text.  Its pre-tokenizer drops white
space and no rule looks across it, so words between ASCII white space, and the
runs that its pattern cuts from plain words, are encoded once and their ids gathered
for each place, in pieces of a long text.

Defined cases: a null or empty text is its end id alone; a null doc_id and repeated
rows are packed like others; extra columns are not touched; an empty table gives no
rows.  The order of the stream is that of the rows in their files.
"""

from __future__ import annotations

import json
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import kernel
from gistmill.llm.common import shared_dir, small_batches
from gistmill.llm.order import before, joined

WIDTH = 2048
END_ID = 1
PIECE_BYTES = 4 << 20
CACHED = 600_000
_TOKENS = "part int, before long, doc_id long, tokens long, ids binary"
# a run that the splitting pattern leaves whole, of lower-case ASCII and Latin letters
_RUN = regex.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
# classes of bytes: white space, letter (the bytes of U+00C0..U+00FF among them), digit, sign, other
_GAP, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[kernel.SPACE] = _GAP
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[ord("'")] = _OTHER


class WordEncoder:
    """Ids of single words, kept for the words seen last.

    Runs that the tokenizer's pattern leaves whole go straight to its model (bytes as
    characters); everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if norm != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"] or pre[1]["add_prefix_space"]:
            raise ValueError("a tokenizer that lowers case, drops white space and splits words by a pattern is needed")
        if any(_RUN.fullmatch(t["content"]) and "<|" not in t["content"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must not be words")
        # printable bytes stand for themselves, the others follow from code point 256 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known.clear()
        out = list(map(self.known.get, words))
        missing, slow = [i for i, ids in enumerate(out) if ids is None], []
        for i in missing:
            text = words[i].decode()
            if _RUN.fullmatch(text) and "<|" not in text:
                tokens = self.model.tokenize(text if text.isascii() else words[i].decode("latin-1").translate(self.shown))
                out[i] = array("I", [t.id for t in tokens]).tobytes()
                self.known[words[i]] = out[i]
            else:
                slow.append(i)
        for i, e in zip(slow, self.whole.encode_batch_fast([words[i].decode() for i in slow], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
            if len(words[i]) < 1024:
                self.known[words[i]] = out[i]
        return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _spans(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end at white space or the end."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data):
            gap = np.flatnonzero(kernel.SPACE[data[end : end + limit]])
            if len(gap):
                end += int(gap[0])
                break
            end += limit
        end = min(end, len(data))
        yield at, end
        at = end


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and starts and ends in them, of what is encoded by itself, in order:
    runs of letters or of signs and single digits, with letters A-Z and U+00C0..U+00DE
    lowered, and whole words as they are where they hold anything else."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]  # the signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    low = kernel.LOWER[data]
    low[lead[data[lead + 1] != 0x9F] + 1] |= 0x20  # all but the sharp s
    starts, ends, _ = kernel.words(data, off)
    mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # special tokens begin so
    odd = np.concatenate((np.flatnonzero(kind == _OTHER), mark))
    odd = np.unique(np.searchsorted(starts, odd, "right") - 1)
    # odd words are one run each: a stretch of _OTHER, bytes as they were
    size = ends[odd] - starts[odd]
    at = np.arange(int(size.sum())) + np.repeat(starts[odd] + size - np.cumsum(size), size)
    kind[at], low[at] = _OTHER, data[at]
    first = np.empty(len(data), bool)
    first[:1] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first[starts] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(data))
    held = kind[begin] != _GAP
    return low, begin[held], end[held]


def word_ids(enc: WordEncoder, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of some texts and, by text, how many."""
    low, starts, ends = runs(data, off)
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low[~kernel.SPACE[low]])])
    coded = every.dictionary_encode()
    found = enc.encode(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(found), "<u4")
    n = np.fromiter(map(len, found), np.int64, len(found)) // 4
    which = coded.indices.to_numpy().astype(np.int64)
    first = (np.cumsum(n) - n)[which]
    n = n[which]
    upto = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)]
    at = np.searchsorted(starts, off)
    return ids, upto[at[1:]] - upto[at[:-1]]


def text_ids(enc: WordEncoder, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a large_string array with the ids of each row, end id last."""
    end = np.array([end_id], "<u4")
    for lo, hi in kernel.groups(texts):
        data, off = kernel.buffers(texts.slice(lo, hi - lo))
        if hi - lo > 1:
            ids, n = word_ids(enc, data, off)
            yield lo, hi, [np.concatenate((x, end)) for x in np.split(ids, np.cumsum(n)[:-1])]
        else:
            pieces = [word_ids(enc, data[a:b], np.array([0, b - a]))[0] for a, b in _spans(data, PIECE_BYTES)]
            yield lo, hi, [np.concatenate((*pieces, end))]


def tokenized(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> DataFrame:
    """part, before, doc_id, tokens, ids (little-endian unsigned 32-bit) of every
    document; `before` counts the ids before it in its part.  Written to the shared
    folder, so parts and places stay what they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, total = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_id, text = kernel.columns(batch, "doc_id", "text")
            for lo, hi, ids in text_ids(enc, kernel.strings(text), end_id):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                place = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part, np.int32)), pa.array(place), doc_id.slice(lo, hi - lo), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "before", "doc_id", "tokens", "ids"],
                )

    spark = docs.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_TOKENS).parquet(path)


def packed(docs: DataFrame, tokenizer: str, *, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start (ids of its document before it), length,
    ids (binary), doc_tokens, sequence_id, offset (in the sequence)."""
    tokens = tokenized(docs, tokenizer, end_id=end_id)
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n"))
    placed = joined(tokens, before(totals, "part", "n").select("part", "base"), "part").withColumn("at", F.col("base") + F.col("before"))
    at, n = F.col("at"), F.col("tokens")

    def piece(s):
        start = F.greatest(s * width - at, F.lit(0))
        length = F.least((s + 1) * width - at, n) - start
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), s.alias("sequence_id"), F.greatest(at - s * width, F.lit(0)).alias("offset"))

    # slices are taken before the explosion: a long document's ids are not repeated for each piece
    pieces = F.transform(F.sequence(F.floor(at / width), F.floor((at + n - 1) / width)), piece)
    out = placed.select("doc_id", F.col("tokens").alias("doc_tokens"), F.explode(pieces).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, *, width: int = WIDTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, length (ids without padding), ids (binary, padded to `width`
    unless the length is a power of two), pieces (doc_id, start, length, offset in
    order).  A sequence gathers at most `width` pieces."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    s = pieces.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("length"))
    joined_ids = F.aggregate("held", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    room = F.when(F.bit_count("length") == 1, 0).otherwise(width - F.col("length")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), room))
    records = F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset")))
    return s.select("sequence_id", "length", F.concat(joined_ids, pad).alias("ids"), records.alias("pieces"))


def digests(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
