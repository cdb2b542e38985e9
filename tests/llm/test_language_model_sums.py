"""Language model: sums in levels, bounded start, probabilities, a loop token by token."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.llm import language_model

DOCS = "doc_id long, text string, n_tokens string, tail int"


def test_sums_of_many_tasks_in_levels(spark):
    parts = spark.range(5_000).select((F.col("id") % 2).cast("int").alias("chunk"), F.floor(F.col("id") / 2).cast("int").alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    once = language_model._added

    def added(rows: pa.Table) -> pa.Table:
        assert len(rows) <= 64
        return once(rows)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_model, "_added", added)
        got = {r.chunk: r.v for r in language_model.summed(parts).collect()}
    assert got == {c: [float(sum(range(c, 5_000, 2))), 2_500.0] for c in (0, 1)}
    assert language_model.summed(parts.where("part = 0")).count() == 2 and language_model.summed(parts.limit(0)).count() == 0


def test_the_start_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_model, "START_CHARS", 50)
    long = "".join(f"w{i} " for i in range(10_000))
    docs = spark.createDataFrame([(1, "short"), (1, "shorter"), (2, long), (3, None), (4, ""), (None, "no id")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in language_model.start_texts(docs).to_pylist()}
    assert got[1] == "shorter" and got[3] is None and got[4] == "" and len(got[2]) == 50 and got[2] in long and len(got) == 4


def test_shares_and_spellings_make_one():
    for counts, others in (([5.0, 3.0, 2.0], 10.0), ([5.0, 0.0, 2.0], 10.0), ([0.0], 0.0), ([4.0, 5.996], 10.0)):
        share, left = language_model.shares(np.array(counts), others)
        assert left >= language_model.LEFT * 0.999 and share.sum() + left == pytest.approx(1, abs=1e-12)
    model = language_model.Model(np.zeros(0, np.uint64))
    n = np.full((257, 257), -0.02)  # two letters and an end
    n[np.ix_([97, 98, 256], [97, 98, 256])] = [[1, 2, 3], [2, 1, 4], [3, 2, 0]]
    n[256, 256] = -0.02
    with np.errstate(divide="ignore", invalid="ignore"):
        model.fit_spelling(n)
    mass, words = 0.0, ["a", "b"]
    for _ in range(11):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        with np.errstate(invalid="ignore"):
            chain = model.spell
            mass += sum(math.exp(chain[256, ord(w[0])] + sum(chain[ord(x), ord(y)] for x, y in zip(w, w[1:], strict=False)) + chain[ord(w[-1]), 256]) for w in words)
        words = [w + c for w in words for c in "ab"]
    assert 0.97 < mass <= 1 + 1e-9 and len(data) == ends[-1]


def test_scores_equal_a_loop_token_by_token():
    model = language_model.Model(np.arange(1, 300, dtype=np.uint64))
    rng = np.random.default_rng(4)
    p, n = {k: v.astype(float) for k, v in model.p.items()}, language_model.HIDDEN
    logistic = lambda v: 1 / (1 + np.exp(-v))
    texts = [rng.integers(2, 300, k).astype(np.int32) for k in (0, 1, 40, 7)]
    want = []
    for text in texts:
        h, last, total = np.zeros(n), language_model.END, 0.0
        for y in [*text, language_model.END]:
            h = h * (last != language_model.END)
            a, r = p["e"][last] @ p["w"] + p["b"], h @ p["u"]
            z, reset = logistic(a[:n] + r[:n]), logistic(a[n : 2 * n] + r[n : 2 * n])
            c = np.tanh(a[2 * n :] + reset * r[2 * n :])
            h = z * h + (1 - z) * c
            cls, at = divmod(int(y), language_model.CLASSES)
            for logits, k in ((h @ p["wc"] + p["bc"], cls), (h @ p["wo"][cls] + p["bo"][cls], at)):
                total += logits[k] - np.log(np.exp(logits).sum())
            last = y
        want.append(total)
    got = model.score(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    np.testing.assert_allclose(got, want, rtol=1e-4)


def test_odd_rows_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TRAIN_DOCS", 5)
    long = "".join(f"w{i % 50} " for i in range(60_000))
    rows = [(None, "no id here", "x", 1), (1, None, "x", 1), (2, "", "x", 2), (3, "twice", None, 3), (3, "Twice", None, 3), (4, long, "x", None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = language_model.scored(docs).collect()
    assert len(got) == 6 and all(r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 4, 60_001]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert language_model.scored(docs.limit(0)).count() == 0
