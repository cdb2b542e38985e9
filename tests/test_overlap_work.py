"""Overlaps are found within the task that holds a document."""

import random

import numpy as np
from pyspark.sql import functions as F

from gistmill.operators import compare

ENTRY = "doc_id long, set_name string, text string, page int"


def test_both_directions_go_through_the_texts_once(spark):
    df = spark.createDataFrame([(1, "a", "a text that is long enough to count", 0), (1, "b", "so: a text that is long enough to count", 1)], ENTRY)
    plan = compare.report(df, "a", "b", F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan
    assert {(r.measure, r.set_name): r.value for r in compare.report(df, "a", "b", F.col("text")).where("measure like 'share%'").collect()} == {("share in b", "a"): 1.0, ("share in a", "b"): 1.0}


def test_contained_equals_all_pairs():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(40, 120))) for _ in range(30)]
    texts = base + [t[k : k + rng.randint(19, 30)] for t in base for k in (0, 9)]
    doc = np.array([rng.randrange(3) for _ in texts])
    short, long = (np.array([rng.random() < 0.6 for _ in texts]) for _ in range(2))
    own, key = compare._postings(texts, doc)
    got = sorted((int(s), int(x)) for ss, ls in compare.contained(texts, doc, short, long, own, key) for s, x in zip(ss, ls, strict=True))
    want = sorted((i, j) for i in range(len(texts)) for j in range(len(texts)) if short[i] and long[j] and doc[i] == doc[j] and texts[i] in texts[j])
    assert got == want and any(i != j for i, j in want)
