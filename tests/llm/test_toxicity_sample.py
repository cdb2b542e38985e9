"""What the driver takes of toxicity's sample."""

import pickle

import numpy as np
import pyarrow as pa

from gistmill.llm import toxicity
from gistmill.llm.kernel import strings


def test_the_driver_takes_four_bytes_a_word(spark):
    texts = {i: f"word{i % 3} Common stays here, rare{i} and \u00e9t\u00e9{i % 7} {'again ' * (i % 5)}" for i in range(1, 41)} | {50: "", 51: None}
    sample = spark.createDataFrame([(i, t, "en", i % 2) for i, t in texts.items()], "doc_id long, text string, lang string, label int").repartition(3)
    keep, got = toxicity.sampled_rows(sample)
    assert got["doc_id"].to_pylist() == sorted(texts)
    # against the same on the driver
    buckets = [toxicity.bucketed(strings(pa.array([texts[i]], pa.string())))[0] for i in sorted(texts)]
    for i, least in enumerate(toxicity.LEAST):
        bucket, n = np.unique(np.concatenate([np.unique(b[:, i]) for b in buckets]), return_counts=True)
        assert np.array_equal(keep[i], bucket[n >= least]) and len(keep[i])
    model = toxicity.Model(keep)
    for b, rows in zip(buckets, got["rows"].to_pylist(), strict=True):
        assert len(rows) == 4 * len(b)
        assert np.array_equal(np.frombuffer(rows, np.int32), model.rows(b))
    assert len(pickle.dumps(model)) < 1 << 20  # the maps that it made stay
