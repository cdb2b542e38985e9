"""Quality: a generalised additive model with pairwise interactions.

Each text becomes a row of counts and ratios (letters, case, digits, signs,
lines, repetition, word lengths).  Every feature is cut into at most BINS bins at
quantiles of the training rows.  Boosting goes round the features in turn; each
visit fits a shallow tree (at most three leaves) to the logistic gradient and
adds it to that feature's lookup table.  The pairs with the largest remaining
gain are then boosted in the same way on coarse two-way grids.  A score is the
sum of table entries, one vectorised gather for each feature and pair.

Training is numpy on the driver over a bounded sample of labelled rows (at most
TRAIN_PER_CLASS of each class, a documented bound); the driver gets one row of
features for each.  Labels, lang, source and doc_id are never inputs.

Defined cases: a null or empty text has all counts zero and is scored as such;
without labelled rows of both classes every score is the share of positives (0.5
without labels); repeated rows are scored each; extra columns are not touched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import fold, labelled_sample
from gistmill.llm.kernel import LOWER, SPACE, buffers, columns, groups, hashes, strings, words
from gistmill.llm.toxicity import platt

TRAIN_PER_CLASS = 10_000
BINS = 32
COARSE = 8
ROUNDS = 80
PAIRS = 6
PAIR_ROUNDS = 25
RATE = 0.15

_UPPER, _LETTER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_HIGH[128:] = True
_SIGN = ~(_LETTER | _DIGIT | _HIGH | SPACE)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SET = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"stop": b".?!", "comma": b",;:", "bang": b"!", "bar": b"|", "odd": b"#$%&*+=<>@^_~\\", "bracket": b"()[]{}", "quote": b"\"'"}.items()}

FEATURES = [
    "log_words", "log_bytes", "word_length", "upper", "digit", "high", "sign", "lines", "line_length",
    "stop", "comma", "bang", "bar", "odd", "bracket", "quote", "distinct_words", "top_word", "distinct_lines",
    "short_words", "long_words", "pair_repeats", "byte_entropy", "sign_ends", "one_byte_words", "capital_words",
]


def _by_text(values: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts, weights=values, minlength=n)


def _repetition(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: distinct hashes, and the count of the commonest one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, owner[at], runs)
    return np.bincount(owner[at], minlength=n).astype(float), most


def features(arr: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a group."""
    n = len(arr)
    data, off = buffers(arr)
    hist = np.zeros((n, 256))
    for i in range(n):
        for a in range(off[i], off[i + 1], 1 << 20):
            hist[i] += np.bincount(data[a : min(a + (1 << 20), off[i + 1])], minlength=256)
    size = np.maximum(hist.sum(1), 1)
    starts, ends, at = words(data, off)
    h = hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    count = np.diff(at).astype(float)
    per_word = np.maximum(count, 1)
    lines, line_ends, line_at = words(data, off, _NEWLINE)
    line_owner = np.repeat(np.arange(n), np.diff(line_at))
    n_lines = np.diff(line_at).astype(float)
    distinct, top = _repetition(h, owner, n)
    own_lines, _ = _repetition(hashes(data, lines, line_ends), line_owner, n)
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) if len(h) else np.zeros(0, bool)
    share = hist / size[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    of = lambda mask: hist[:, mask].sum(1) / size
    end_sign = _SIGN[data[ends - 1]].astype(float) if len(ends) else np.zeros(0)
    capital = _UPPER[data[starts]].astype(float) if len(starts) else np.zeros(0)
    cols = [
        np.log1p(count), np.log1p(off[1:] - off[:-1]), _by_text(length, owner, n) / per_word, of(_UPPER), of(_DIGIT), of(_HIGH), of(_SIGN),
        n_lines / per_word, count / np.maximum(n_lines, 1), *(of(_SET[k]) for k in ("stop", "comma", "bang", "bar", "odd", "bracket", "quote")),
        distinct / per_word, top / per_word, own_lines / np.maximum(n_lines, 1), _by_text((length <= 3).astype(float), owner, n) / per_word,
        _by_text((length >= 12).astype(float), owner, n) / per_word, np.bincount(owner[1:][same], minlength=n) / per_word, entropy,
        _by_text(end_sign, owner, n) / per_word, _by_text((length == 1).astype(float), owner, n) / per_word, _by_text(capital, owner, n) / per_word,
    ]
    return np.stack(cols, 1)


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[bins[:, i] * COARSE // BINS, bins[:, j] * COARSE // BINS]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(self.bins(x)) + b, -30, 30)))


def _value(g, h):
    return -g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of the best tree with at most three leaves: the best
    cut, then the better cut of one of its halves."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(gl):
            return 0.0, lo
        gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    ends = [0, len(g)]
    for _ in range(2):
        gain, at = max(cut(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True))
        if gain <= 1e-9:
            break
        ends = sorted({*ends, at})
    out = np.empty(len(g))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one axis with a cut of the other on either side: gain and values."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(a)):
            out, gain = np.empty_like(a), 0.0
            for part in (slice(0, k), slice(k, len(a))):
                gs, hs = a[part].sum(0), b[part].sum(0)
                leaf = _tree(gs, hs)
                out[part] = leaf
                gain -= float((leaf * gs).sum() * 2 + (leaf**2 * (hs + 1e-9)).sum())
            if gain > best[0]:
                best = (gain, out.T if turn else out)
    return best


def train(x: np.ndarray, y: np.ndarray, totals: dict[int, int] | None = None) -> Model:
    if len(y) < 10 or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(11)
    calib = rng.random(len(y)) < 0.15
    for v in (0, 1):
        which = np.flatnonzero(y == v)
        calib[which[:2]] = [True, False] if len(which) > 1 else [False]
    fx, fy = x[~calib], y[~calib].astype(float)
    model = Model([np.unique(np.quantile(fx[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])])
    bins = model.bins(fx)
    model.tables = [np.zeros(BINS) for _ in model.cuts]
    rate = np.clip(fy.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    f = np.full(len(fy), model.base)
    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            leaf = RATE * _tree(np.bincount(bins[:, i], p - fy, BINS), np.bincount(bins[:, i], p * (1 - p), BINS))
            t += leaf
            f += leaf[bins[:, i]]
    small = bins * COARSE // BINS
    grids = lambda i, j: [np.bincount(small[:, i] * COARSE + small[:, j], w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (p - fy, p * (1 - p))]
    p = 1 / (1 + np.exp(-f))
    ranked = sorted(((_grid_tree(*grids(i, j))[0], i, j) for i in range(len(model.cuts)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            p = 1 / (1 + np.exp(-f))
            leaf = RATE * _grid_tree(*grids(i, j))[1]
            t += leaf
            f += leaf[small[:, i], small[:, j]]
    held = y[calib]
    share = np.array([(totals or {}).get(v, (y == v).sum()) / (y == v).sum() for v in (0, 1)])
    model.scale = platt(model.raw(model.bins(x[calib])), held.astype(float), (share / share.mean())[held])
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, label = columns(batch, "doc_id", "text", "label")
        arr = strings(text)
        x = np.concatenate([np.zeros((0, len(FEATURES))), *(features(arr.slice(lo, hi - lo)) for lo, hi in groups(arr, 1 << 20))])
        yield pa.RecordBatch.from_arrays([ids, label, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", left_out: int = 0, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Train on labelled rows outside fold `left_out`."""
    sample, totals = labelled_sample(docs, labels, label, per_class, left_out=left_out)
    rows = sample.select("doc_id", "text", "label").mapInArrow(_rows, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist())).reshape(-1, len(FEATURES))
    return train(x, rows["label"].to_numpy().astype(int), totals)


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            arr = strings(batch.column(0))
            s = np.concatenate([np.zeros(0), *(m.score(features(arr.slice(lo, hi - lo))) for lo, hi in groups(arr, 1 << 20))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s)], [*batch.schema.names[1:], "__score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and __score (0 to 1, higher: label 1 likelier)."""
    asked = docs.select(F.col("text").alias("__text"), *keep)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    types = dict(asked.dtypes)
    return asked.mapInArrow(_score(sent), ", ".join([*(f"`{c}` {types[c]}" for c in keep), "__score double"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every row."""
    out = score(docs, fit(docs, labels), ["doc_id"]).withColumnRenamed("__score", "score")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
