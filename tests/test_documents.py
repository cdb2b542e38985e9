"""Chunks over documents that span Arrow batches, and how often sentences are worked out."""

import random

from pyspark.sql import functions as F

from gistmill.operators import budget, segment

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_chunks_over_small_batches(spark, rows):
    rng = random.Random(3)
    lengths = {d: [rng.randint(40, 300) for _ in range(n)] for d, n in ((1, 60), (2, 1), (3, 7), (4, 25), (None, 5), (9, 14))}
    sents = [(d, i, i // 4, "x" * n, "body") for d, every in lengths.items() for i, n in enumerate(every)]
    rng.shuffle(sents)
    df = spark.createDataFrame(sents, "doc_id long, sent_id long, page_index int, text string, section string")
    want = []
    for d, every in lengths.items():
        if d is not None:
            ids = budget.chunk_ids(every, [("body", i // 4) for i in range(len(every))], 200)
            want += [(d, i, c, i - ids.index(c)) for i, c in enumerate(ids)]
    before = spark.conf.get(KEY)
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set(KEY, size)
            assert rows(budget.chunks(df, 200), "doc_id", "sent_id", "chunk_id", "local_id") == sorted(want, key=repr)
            whole = rows(budget.banded_chunks(df, 10_000), "doc_id", "sent_id", "unit_id")
            assert whole == rows(budget.bands(df, budget.band_plan(df)), "doc_id", "sent_id", "band_id")
    finally:
        spark.conf.set(KEY, before)


def test_sentences_are_worked_out_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("A sentence that is long enough to be a candidate here. " * 20).alias("text"))
    s = segment.numbered(segment.candidates(segment.lines(docs))).withColumn("section", F.lit("body"))
    for df in (budget.chunks(s, 100), budget.banded_chunks(s, 100)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        tree = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
        assert tree.count("Range (") == 1 and tree.count("Exchange hashpartitioning") <= 1
