"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits (A-Z lowered), hashed to 2**21 buckets, and
so are their beginnings of five and four bytes.  A word takes the embedding of its
own bucket if enough training texts have it, else that of its longer, then its
shorter beginning, else one fixed zero vector.
Filters one, two and three words wide run over the whole text, each is pooled by
its maximum, and a logistic layer weighs the pools.  Training is plain numpy on
the driver, on a bounded sample of labelled rows (at most TRAIN_PER_CLASS of
each class, a documented bound), with sparse gradients: a maximum passes its
gradient to one window only.  Tasks find which buckets have enough texts and turn the
sample into rows of the embeddings, so the driver takes 4 bytes a word.  Scoring multiplies embeddings and filters once
into a table of rows, so a text costs one gather and add for each word and
filter tap.

A fifth of the sample calibrates: a logistic fit maps the raw sum to a
probability, and each language with enough rows gets the threshold of best F1,
held to THRESHOLD_RANGE; other languages take that of all rows.  Labels, lang,
source and doc_id are never inputs of a score.

Defined cases: a null or empty text scores as a text without words; a null lang
or one unknown to training has the general threshold; without labelled rows of
both classes every score is the share of positives (0.5 without labels);
repeated rows are scored each; extra columns stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import fold, labelled_sample, table
from gistmill.llm.kernel import NOT_LETTER, buffers, columns, groups, hashes, strings, words

BUCKET_BITS = 21
TRAIN_PER_CLASS = 4_000
HEADS = (5, 4)
LEAST = (5, 3, 3)
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 12
PAD = max(WIDTHS) - 1
THRESHOLD_RANGE = (0.3, 0.7)
#: Texts go through in groups of about so many bytes: arrays of a group take many times that.
GROUP_BYTES = 512 << 10
_BLOCK_BITS = 7


def bucketed(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each word of a group of texts: the buckets of the word and of its
    beginnings; and by text the range of its words."""
    data, off = buffers(arr)
    starts, ends, at = words(data, off, NOT_LETTER)
    parts = [hashes(data, starts, np.minimum(ends, starts + n)) ^ np.uint64(n << 43) for n in HEADS]
    return np.stack([(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for h in (hashes(data, starts, ends), *parts)], 1), at


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with PAD zero rows after each text (and one at least in each), and
    the interleaved segment bounds for reduceat."""
    n = len(at) - 1
    texts = np.repeat(np.arange(n), np.diff(at))
    gap = PAD + 1
    out = np.zeros(len(ids) + gap * n, ids.dtype)
    out[np.arange(len(ids)) + gap * texts] = ids
    bounds = np.empty(2 * n, np.int64)
    bounds[::2] = at[:-1] + gap * np.arange(n)
    bounds[1::2] = np.maximum(at[1:] + gap * np.arange(n), bounds[::2] + 1)
    return out, bounds


def places(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where buckets stand in `keep` (ascending, without repeats), in 2 MB: by bucket one
    more than the kept ones before it in its block, 0 for others; by block those before it."""
    before = np.searchsorted(keep, np.arange(0, 1 << BUCKET_BITS, 1 << _BLOCK_BITS)).astype(np.int32)
    within = np.zeros(1 << BUCKET_BITS, np.uint8)
    within[keep] = np.arange(1, len(keep) + 1) - before[keep >> _BLOCK_BITS]
    return within, before


@dataclass
class Model:
    keep: list[np.ndarray]  # by word, longer, shorter beginning: buckets with a row; row 0 is for all others
    taps: list[np.ndarray] = field(default_factory=list)  # by width: rows x width x filters
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_places"}  # 6 MB that tasks work out anew

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_places"):
            self._places = [places(keep) for keep in self.keep]
        out, first = np.zeros(len(buckets), np.int32), 0
        for i, (within, before) in enumerate(self._places):
            none = np.flatnonzero(out == 0)
            asked = buckets[none, i]
            at = within[asked]
            out[none] = np.where(at > 0, before[asked >> _BLOCK_BITS] + at + first, 0)
            first += len(self.keep[i])
        return out

    def raw(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids, bounds = padded(rows, at)
        pools = []
        for w, tap, b in zip(WIDTHS, self.taps, self.bias, strict=True):
            span = len(ids) - w + 1
            conv = tap[ids[:span], 0]
            for j in range(1, w):
                conv += tap[ids[j : j + span], j]
            pools.append(np.maximum(np.maximum.reduceat(conv, bounds, axis=0)[::2] + b, 0))
        return np.concatenate(pools, axis=1) @ self.out + self.out_bias

    def score(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(self.rows(buckets), at).astype(np.float64) + b, -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(None, 0.5))


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on raw, by Newton steps with a slight pull to (1, 0)."""
    p = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ (weight * (q - y)) + 0.5 * (p - [1, 0])
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2)
        p = p - np.linalg.solve(hess, grad)
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def _best_f1(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    grid = np.linspace(*THRESHOLD_RANGE, 41)
    f1 = np.array([2 * (weight * ((score >= t) & (y == 1))).sum() / max(1e-9, (weight * (score >= t)).sum() + (weight * (y == 1)).sum()) for t in grid])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(grid[best[np.argmin(np.abs(grid[best] - 0.5))]])


def train(keep: list[np.ndarray], rows: list[np.ndarray], y: np.ndarray, langs: list, totals: dict[int, int] | None = None, *, epochs: int = 4, seed: int = 7) -> Model:
    """rows: those of each sampled text's words, by the buckets `keep`; langs only choose
    thresholds; totals: labelled rows by class, to calibrate to their true share."""
    rng = np.random.default_rng(seed)
    if len(y) < 10 or y.min() == y.max():
        return Model([], constant=float(y.mean()) if len(y) else 0.5)
    calib = rng.random(len(y)) < 0.2
    for v in (0, 1):  # both parts have both classes
        which = np.flatnonzero(y == v)
        calib[which[:2]] = [True, False] if len(which) > 1 else [False]
    model = Model(keep)
    n = sum(map(len, model.keep)) + 1
    # how much likelier a row is in positives, less for rare rows, starts the first embedding dimension
    part = np.flatnonzero(~calib)
    count = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(rows[i]) for i in part if y[i] == v)]), minlength=n) for v in (0, 1)]
    share = [(c + 0.3) / ((y[part] == v).sum() + 0.6) for v, c in enumerate(count)]
    met = count[0] + count[1]
    odds = np.log(share[1] / share[0]) * met / (met + 8)
    emb = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(odds, -3, 3) / 3
    emb[0] = 0
    filt = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    for k in range(len(WIDTHS)):
        filt[k][0, 0, :2] = 2.0
    out = np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32)
    out_b = np.float32(-1.0)
    params = [*filt, *bias, out]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    ada = np.full(n, 1e-3, np.float32)
    weight = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0) ** 0.5
    step, ob = 0, [0.0, 0.0]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / (epochs + 1))
        for lot in np.array_split(rng.permutation(part), max(1, len(part) // 48)):
            ids, bounds = padded(np.concatenate([rows[i] for i in lot]), np.cumsum([0, *(len(rows[i]) for i in lot)]))
            pools, places = [], []
            for w, f, b in zip(WIDTHS, filt, bias, strict=True):
                span = len(ids) - w + 1
                conv = np.zeros((span, FILTERS), np.float32)
                for j in range(w):
                    conv += (emb @ f[j])[ids[j : j + span]] if n < len(ids) else emb[ids[j : j + span]] @ f[j]
                where = np.stack([s + conv[s:e].argmax(0) for s, e in zip(bounds[::2], bounds[1::2], strict=True)])
                pools.append(conv[where, np.arange(FILTERS)] + b)
                places.append(where)
            z = np.concatenate(pools, 1)
            on = (z > 0).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip((z * on) @ out + out_b, -30, 30)))
            g = ((p - y[lot]) * weight[lot] / len(lot)).astype(np.float32)
            gz = g[:, None] * out * on
            grads_f, grads_b = [], []
            touched, moves = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, filt, strict=True)):
                gk = gz[:, k * FILTERS : (k + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(w):
                    at = ids[places[k] + j]
                    gf[j] = np.einsum("bf,bfd->df", gk, emb[at])
                    moves.append((gk[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                    touched.append(at.reshape(-1))
                grads_f.append(gf)
                grads_b.append(gk.sum(0))
            step += 1
            for q, gq, (m, v) in zip(params, [*grads_f, *grads_b, (z * on).T @ g + 1e-4 * out], mom, strict=True):
                m += 0.1 * (gq - m)
                v += 0.001 * (gq * gq - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            gb = float(g.sum())
            ob = [ob[0] + 0.1 * (gb - ob[0]), ob[1] + 0.001 * (gb * gb - ob[1])]
            out_b -= np.float32(rate * (ob[0] / (1 - 0.9**step)) / (np.sqrt(ob[1] / (1 - 0.999**step)) + 1e-8))
            where, move = np.concatenate(touched), np.concatenate(moves)
            hit, back = np.unique(where, return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, back, move)
            ada[hit] += (total * total).sum(1)
            emb[hit] -= rate * total / np.sqrt(ada[hit])[:, None]
            emb[0] = 0
    model.taps = [np.ascontiguousarray(np.stack([emb @ f[j] for j in range(len(f))], 1).astype(np.float32)) for f in filt]
    model.bias, model.out, model.out_bias = bias, out, float(out_b)
    held = np.flatnonzero(calib)
    raw = np.concatenate([model.raw(rows[i], np.array([0, len(rows[i])])) for i in held]).astype(np.float64)
    share = np.array([(totals or {}).get(v, (y == v).sum()) / (y == v).sum() for v in (0, 1)])
    share = (share / share.mean())[y[held]]
    model.scale = platt(raw, y[held].astype(float), share)
    score = 1 / (1 + np.exp(-np.clip(model.scale[0] * raw + model.scale[1], -30, 30)))
    model.thresholds[None] = _best_f1(score, y[held], share)
    for lang in {langs[i] for i in held if langs[i] is not None}:
        which = np.array([langs[i] == lang for i in held])
        if y[held][which].sum() >= 20 and (y[held][which] == 0).sum() >= 20:
            model.thresholds[lang] = _best_f1(score[which], y[held][which], share[which])
    return model


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, lang, label = columns(batch, "doc_id", "text", "lang", "label")
        arr, out = strings(text), []
        for lo, hi in groups(arr, GROUP_BYTES):
            b, at = bucketed(arr.slice(lo, hi - lo))
            out += [b[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([ids, lang, label, pa.array(out, pa.binary())], ["doc_id", "lang", "label", "words"])


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, bucket, n): in how many of this task's texts a bucket stands, by its place in LEAST."""
    for batch in batches:
        met = [np.frombuffer(b, np.int32).reshape(-1, len(LEAST)) for b in batch.column(0).to_pylist()]
        for i in range(len(LEAST)):
            bucket, n = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.unique(t[:, i]) for t in met)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket), pa.array(n, pa.int64())], ["place", "bucket", "n"])


def _as_rows(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(pickle.loads(sent.value))
        for batch in batches:
            ids, lang, label, text = columns(batch, "doc_id", "lang", "label", "words")
            out = [model.rows(np.frombuffer(b, np.int32).reshape(-1, len(LEAST))).tobytes() for b in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, lang, label, pa.array(out, pa.binary())], ["doc_id", "lang", "label", "rows"])

    return run


def sampled_rows(sample: DataFrame) -> tuple[list[np.ndarray], pa.Table]:
    """The buckets that at least LEAST texts of (doc_id, text, lang, label) have, and
    (doc_id, lang, label, rows): a row of 4 bytes for each word, by doc_id."""
    hashed = table(sample.select("doc_id", "text", "lang", "label").mapInArrow(_hashed, "doc_id long, lang string, label int, words binary"), "toxic-words")
    counts = hashed.select("words").mapInArrow(_texts_with, "place int, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= F.element_at(F.array(*map(F.lit, LEAST)), F.col("place") + 1)).select("place", "bucket").toArrow()  # at most 2**BUCKET_BITS of a place
    place, bucket = kept["place"].to_numpy(), kept["bucket"].to_numpy()
    keep = [np.sort(bucket[place == i]) for i in range(len(LEAST))]
    sent = sample.sparkSession.sparkContext.broadcast(pickle.dumps(keep))
    return keep, hashed.mapInArrow(_as_rows(sent), "doc_id long, lang string, label int, rows binary").toArrow().sort_by("doc_id")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", left_out: int = 0, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Train on rows outside fold `left_out`; the driver gets rows of embeddings for
    the words of at most 2 * per_class texts."""
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    sample, totals = labelled_sample(docs, labels, label, per_class, left_out=left_out, extra=("lang",))
    keep, got = sampled_rows(sample)
    rows = [np.frombuffer(b.as_buffer(), np.int32) for b in got["rows"]]
    return train(keep, rows, got["label"].to_numpy().astype(int), got["lang"].to_pylist(), totals)


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            arr, parts = strings(batch.column(0)), [np.zeros(0)]
            for lo, hi in groups(arr, GROUP_BYTES):
                parts.append(m.score(*bucketed(arr.slice(lo, hi - lo))))
            score = np.concatenate(parts)
            lang = batch.column(1).to_pylist()
            bad = np.array([s >= m.threshold(x) for s, x in zip(score, lang, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(score), pa.array(bad)], [*batch.schema.names[2:], "__score", "__rejected"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, __score, and __rejected (the score reaches the
    threshold of the row's language); names that no column of docs should have."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    asked = docs.select(F.col("text").alias("__text"), lang.alias("__lang"), *keep)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    types = dict(asked.dtypes)
    return asked.mapInArrow(_score(sent), ", ".join([*(f"`{c}` {types[c]}" for c in keep), "__score double", "__rejected boolean"]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), rejected of every row."""
    out = score(docs, fit(docs, labels), ["doc_id"]).withColumnsRenamed({"__score": "score", "__rejected": "rejected"})
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return score(docs, fit(docs, labels), docs.columns).where(~F.col("__rejected")).select(*docs.columns)
