"""What a worker holds beside its input, as numpy tells it to tracemalloc."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from gistmill.llm import jaccard_join, kernel, toxicity

MB = 1 << 20


class Sent:
    def __init__(self, value):
        self.value = value


def texts(n=1_000, words=900):
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i:x}{i % 7}" for i in range(5_000)])
    return [" ".join(vocab[rng.integers(0, len(vocab), words)]) for _ in range(n)]


def model(n=20_000):
    rng = np.random.default_rng(1)
    keep = [np.sort(rng.choice(1 << toxicity.BUCKET_BITS, n, replace=False)).astype(np.int32) for _ in toxicity.LEAST]
    taps = [rng.normal(0, 1, (3 * n + 1, w, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    return toxicity.Model(keep, taps, [np.zeros(toxicity.FILTERS, np.float32)] * len(taps), np.ones(toxicity.FILTERS * len(taps), np.float32))


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()
        kernel._powers.clear()


def test_scoring_takes_little_beside_the_model():
    m = model()
    batch = pa.RecordBatch.from_arrays([pa.array(texts()), pa.nulls(1_000, pa.string()), pa.array(range(1_000))], ["__text", "__lang", "doc_id"])
    sent = Sent(pickle.dumps(m))
    kernel._powers.clear()
    assert peak(lambda: list(toxicity._score(sent)(iter([batch])))) < len(sent.value) / MB + 40


def test_hashing_and_sets_take_little():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts()), pa.nulls(1_000, pa.string()), pa.array([1] * 1_000, pa.int32())], ["doc_id", "text", "lang", "label"])
    kernel._powers.clear()
    assert peak(lambda: list(toxicity._hashed(iter([batch])))) < 50
    held = 900 * 1_000 * 8 / MB
    assert peak(lambda: list(jaccard_join._sets_and_counts(5)(iter([batch])))) < 3 * held + 20


def test_rows_of_buckets_by_hand():
    m = toxicity.Model([np.array([0, 5, 127, 128, 129, 2**21 - 1]), np.array([7, 300]), np.zeros(0, np.int64)])
    asked = np.array([[0, 7, 7], [5, 1, 1], [127, 1, 1], [128, 300, 1], [129, 1, 1], [2**21 - 1, 7, 7], [6, 7, 7], [6, 300, 7], [6, 8, 0], [256, 128, 128]], np.int32)
    assert m.rows(asked).tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 0, 0]
    full = toxicity.Model([np.arange(256), np.zeros(0, np.int64), np.zeros(0, np.int64)])  # whole blocks
    assert full.rows(np.repeat(np.arange(257, dtype=np.int32)[:, None], 3, 1)).tolist() == [*range(1, 257), 0]
    assert pickle.loads(pickle.dumps(m)).rows(asked).tolist() == m.rows(asked).tolist()
    assert m.rows(asked[:0]).tolist() == []


def test_recurring_is_what_unique_counts():
    rng = np.random.default_rng(5)
    top = np.uint64(2**64 - 1)
    for held in ([rng.integers(0, 50, 40).astype(np.uint64), rng.integers(0, 200, 90).astype(np.uint64)], [np.array([3], np.uint64)], [np.array([], np.uint64)], [np.array([top, 0], np.uint64), np.array([top, top], np.uint64)]):
        x, n = np.unique(np.concatenate(held), return_counts=True)
        got, times = jaccard_join.recurring(held)
        assert got.dtype == np.uint64 and got.tolist() == x[n > 1].tolist() and times.tolist() == n[n > 1].tolist() and not held
