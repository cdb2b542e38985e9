"""Containment between annotation sets against all pairs, and at one long document."""

import random
import time

from pyspark.sql import functions as F

from gistmill.operators import compare

ENTRY = "doc_id long, set_name string, text string, page int"


def _matched(rows):
    out = {}
    for a, b in (("a", "b"), ("b", "a")):
        mine = [(d, t) for d, s, t, _ in rows if s == a]
        other = [(d, t) for d, s, t, _ in rows if s == b and t is not None and len(t) > 20]
        out[a] = (sum(t is not None and len(t) >= 20 and any(d == e and (t in u or u in t) for e, u in other) for d, t in mine), len(mine))
    return out


def test_overlap_equals_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé \U0001f600") for _ in range(rng.randint(15, 90))) for _ in range(40)]
    rows = [(d, s, t, 0) for d in (1, 2) for s in "ab" for t in rng.sample(base, 12)]
    for t in base:  # parts of texts, at the least lengths too
        n = rng.randint(18, 24)
        at = rng.randint(0, max(0, len(t) - n))
        rows.append((rng.choice((1, 2)), rng.choice("ab"), t[at : at + n], 0))
    rows += [(1, "a", None, 0), (1, "b", "", 0), (None, "a", base[0], 0), (1, "a", "x" * 500, 0), (1, "b", "x" * 21, 0), (1, "a", "x" * 500, 0)]
    df = spark.createDataFrame(rows, ENTRY)
    want = _matched(rows)
    for a, b in (("a", "b"), ("b", "a")):
        got = compare.overlap(df, a, b, F.col("text")).first()
        assert (got.matched, got.total) == want[a]
    assert 0 < want["a"][0] < want["a"][1]


def test_an_empty_side(spark):
    df = spark.createDataFrame([(1, "a", "a text that is long enough to count", 0)], ENTRY)
    assert tuple(compare.overlap(df, "a", "b", F.col("text")).first()) == (0, 1, 0.0)
    assert tuple(compare.overlap(df, "b", "a", F.col("text")).first()) == (0, 0, 0.0)


def test_anchors():
    text = "".join(chr(97 + i * i * i % 26) for i in range(3000)) + "é\U0001f600" * 20
    texts = [text, "", text[1000:1200], "x" * 18, "x" * 19, "x" * 40, text[-15:]]
    own, anchor = compare.anchors(texts)
    by = {i: set(anchor[own == i].tolist()) for i in range(len(texts))}
    assert by[2] <= by[0] and len(by[2]) > 1
    assert not by[1] and not by[3] and not by[6] and len(by[4]) == 1 and by[4] == by[5]
    for i, t in enumerate(texts):  # a text's anchors do not depend on its neighbours
        assert set(compare.anchors([t])[1].tolist()) == by[i]
    assert len(compare.anchors([])[0]) == len(compare.anchors(["short", "x"])[0]) == 0


def test_one_document_of_many_lines(spark):
    n = F.col("id")
    lines = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("set_name"), F.concat(F.lit("every line begins with this phrase: "), F.sha2((n % 70_000).cast("string"), 256)).alias("text"), F.lit(0).alias("page"))
    began = time.time()
    got = compare.overlap(lines, "a", "b", F.col("text")).first()
    assert time.time() - began < 60
    assert (got.matched, got.total) == (0, 50_000)
    lines = lines.withColumn("text", F.when((F.col("set_name") == "b"), F.concat(F.lit("and "), "text")).otherwise(F.col("text"))).withColumn("set_name", F.when(F.rand(3) < 0.5, "a").otherwise("b"))
    held = lines.select("set_name", F.regexp_replace("text", "^and ", "").alias("t")).groupBy("t").agg(F.count_if(F.col("set_name") == "a").alias("a"), F.count_if(F.col("set_name") == "b").alias("b"))
    got = compare.overlap(lines, "a", "b", F.col("text")).first()
    assert got.total == 100_000 - lines.where("set_name = 'b'").count()
    assert got.matched == held.where("b > 0").agg(F.sum("a")).first()[0]
