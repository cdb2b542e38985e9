"""Comparison of two annotation sets of the same documents.

entries: doc_id, set_name, text, page.  Overlap looks for containment within a
document.  Texts meet by anchors: a text's anchors are the least hashes of GRAM-
character runs in each window of WINDOW such runs, so whatever contains a text has all
its anchors.  The contained side offers its rarest anchor only, and what meets there is
verified, so work follows the true overlaps and not the pairs of a document's lines.
Texts are dealt by document once; anchors stay in the task that makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators.documents import through

LEAST_TEXT = 20
GRAM, WINDOW = 8, 12  # a text of GRAM + WINDOW - 1 characters or more has an anchor
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, anchor) of the distinct anchors of some texts, in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(codes) - GRAM - WINDOW + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h = (h + codes[j : j + len(h)] + np.uint64(1)) * _ODD
        h ^= h >> np.uint64(29)
    low, width = h, 1
    while 2 * width <= WINDOW:  # least of `width` neighbours, doubled
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[:n], low[WINDOW - width :][:n])
    own = np.repeat(np.arange(len(texts)), size)[:n]
    within = own == np.repeat(np.arange(len(texts)), size)[GRAM + WINDOW - 2 :]
    own, low = own[within], low[within]
    change = np.flatnonzero((own[1:] != own[:-1]) | (low[1:] != low[:-1])) + 1
    first = np.concatenate(([0], change)) if len(own) else change
    own, low = own[first], low[first]
    order = np.lexsort((low, own))
    own, low = own[order], low[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (low[1:] != low[:-1])
    return own[new], low[new].view(np.int64)


def _postings(texts: list[str], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of all texts, by key; texts of one document with an anchor in
    common have a key in common."""
    owns, keys, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    ends = np.cumsum([len(t) for t in texts])
    while at < len(texts):  # groups of about _PIECE characters
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE)))
        own, anchor = anchors(texts[at:end])
        owns.append(own + at)
        keys.append((anchor.view(np.uint64) ^ (doc[own + at].astype(np.uint64) * _ODD)) * _ODD)
        at = end
    own, key = np.concatenate(owns), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return own[order], key[order]


def contained(texts: list[str], doc: np.ndarray, short: np.ndarray, long: np.ndarray, own: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(s, l) pairs, in pieces, of a text marked `short` that stands in a text marked
    `long` of its document; own, key are the postings of texts."""
    if not len(own):
        return
    held = np.flatnonzero(long[own])  # postings of long texts, by key
    lo, hi = np.searchsorted(key[held], key), np.searchsorted(key[held], key, "right")
    mine = np.flatnonzero(short[own])
    rarest = mine[np.lexsort(((hi - lo)[mine], own[mine]))]
    rarest = rarest[np.concatenate(([True], own[rarest][1:] != own[rarest][:-1]))] if len(rarest) else rarest
    n = (hi - lo)[rarest]
    upto = np.cumsum(n)
    at = 0
    while at < len(rarest):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PIECE)))
        size = n[at:end]
        s = np.repeat(own[rarest[at:end]], size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[rarest[at:end]], size)
        l = own[held[place]]  # noqa: E741
        may = np.flatnonzero(doc[s] == doc[l])
        s, l = s[may], l[may]  # noqa: E741
        true = np.fromiter((texts[i] in texts[j] for i, j in zip(s.tolist(), l.tolist(), strict=True)), bool, len(s))
        yield s[true], l[true]
        at = end


def matches(entries: DataFrame, a: str, b: str, norm: Column) -> DataFrame:
    """in_a, in_b: by task, the rows of each set that contain, or are contained in, a
    text of the other one of their document."""
    e = entries.select("doc_id", norm.alias("norm"), (F.col("set_name") == a).alias("in_a"), (F.col("set_name") == b).alias("in_b"))
    e = e.where((F.length("norm") >= LEAST_TEXT) & (F.col("in_a") | F.col("in_b")))

    def work(made: pa.Table, bounds: np.ndarray) -> pa.Table:
        line, docs = made["norm"].to_pylist(), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        number: dict[tuple, int] = {}
        text = np.array([number.setdefault(x, len(number)) for x in zip(docs.tolist(), line, strict=True)], np.int64)
        texts, doc = [t for _, t in number], np.array([d for d, _ in number], np.int64)
        rows = [np.bincount(text, weights=made[c].to_numpy(), minlength=len(texts)) for c in ("in_a", "in_b")]
        longer = np.fromiter((len(t) > LEAST_TEXT for t in texts), bool, len(texts))
        own, key = _postings(texts, doc)
        hit = [np.zeros(len(texts), bool), np.zeros(len(texts), bool)]
        for x, y in ((0, 1), (1, 0)):  # texts of set x in those of set y
            for s, l in contained(texts, doc, rows[x] > 0, rows[y] > 0, own, key):  # noqa: E741
                hit[x][s[longer[l]]] = True
                hit[y][l[longer[s]]] = True
        return pa.table({c: pa.array([int(r[h].sum())], pa.int64()) for c, r, h in zip(("in_a", "in_b"), rows, hit, strict=True)})

    return through(e, "in_a", work, "in_a long, in_b long")


def partition_by_tags(annotations: DataFrame, tags: list[str], inside: str, outside: str) -> DataFrame:
    """set_name by whether an annotation carries one of the tags."""
    has = F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return annotations.withColumn("set_name", F.when(F.coalesce(has, F.lit(False)), inside).otherwise(outside))


def page_of(sort_index: Column) -> Column:
    return F.coalesce(F.split(sort_index, r"\|")[0].try_cast("int"), F.lit(0))


def _shares(entries: DataFrame, a: str, b: str, norm: Column) -> DataFrame:
    """One row: matched and total of each of two sets."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("in_a", "matched_a"), ("in_b", "matched_b"))]
    totals = [F.count_if(F.col("set_name") == s).alias(n) for s, n in ((a, "total_a"), (b, "total_b"))]
    return entries.agg(*totals).join(matches(entries, a, b, norm).agg(*sums))


def _share(matched: str, total: str) -> Column:
    return F.when(F.col(total) == 0, 0.0).otherwise(F.col(matched) / F.col(total))


def overlap(entries: DataFrame, a: str, b: str, norm: Column) -> DataFrame:
    """matched, total, share: how many of set a contain, or are contained in, a text of
    set b; short texts never match but count; 0 where a side is empty."""
    one = _shares(entries, a, b, norm)
    return one.select(F.col("matched_a").alias("matched"), F.col("total_a").alias("total"), _share("matched_a", "total_a").alias("share"))


def set_stats(entries: DataFrame, span: Column) -> DataFrame:
    """n, pages, thirds of the span and mean length (half up) of each set."""
    third = F.least(F.lit(2), F.floor(F.col("page") * 3 / span))
    thirds = [F.count_if(third == i).alias(name) for i, name in enumerate(("first_third", "second_third", "last_third"))]
    return entries.groupBy("set_name").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), *thirds, F.floor(F.avg(F.length("text")) + 0.5).cast("long").alias("mean_chars"))


def page_span(entries: DataFrame) -> DataFrame:
    return entries.agg((F.max("page") + 1).alias("span"))


def report(entries: DataFrame, a: str, b: str, norm: Column) -> DataFrame:
    """measure, set_name, value: statistics of both sets and their overlaps, in rows."""
    stats = set_stats(entries.join(F.broadcast(page_span(entries))), F.col("span"))  # one row
    names = ["n", "pages", "first_third", "second_third", "last_third", "mean_chars"]
    long = stats.unpivot("set_name", names, "measure", "value").select("measure", "set_name", F.col("value").cast("double").alias("value"))
    one = _shares(entries, a, b, norm)  # both directions at once
    told = [F.struct(F.lit(f"share in {y}").alias("measure"), F.lit(x).alias("set_name"), _share(f"matched_{c}", f"total_{c}").alias("value")) for c, x, y in (("a", a, b), ("b", b, a))]
    return long.unionByName(one.select(F.inline(F.array(*told))))
