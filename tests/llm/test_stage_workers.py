"""Stages that run by themselves, without the registered query around them."""

import os

import pyarrow as pa
import pytest

import corpus_pipeline
from gistmill.workers import WORKER_ENV


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_workers_of_a_stage_give_memory_back(spark, name, stage, monkeypatch):
    for key in WORKER_ENV:
        monkeypatch.delitem(spark.sparkContext.environment, key, raising=False)
    with pytest.raises(Exception):  # there is no input: the setting comes before anything is read
        stage(spark, None, "/nowhere")
    told = lambda batches: (pa.RecordBatch.from_arrays([pa.array([os.environ.get(k, "") for k in WORKER_ENV])], ["v"]) for _ in batches)
    got = spark.range(1, numPartitions=1).mapInArrow(told, "v string").collect()
    assert [r.v for r in got] == list(WORKER_ENV.values())
