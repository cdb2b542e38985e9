"""Mined url rules against counted subsets, and hosts of many labels."""

import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from gistmill.llm import url_filter

ROWS = "tokens array<string>, verdict string"


def brute(rows):
    """Rules by counting every subset of every row."""
    held, said = {}, {}
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(set(tokens)), k):
                held[c] = held.get(c, 0) + 1
                said[c, verdict] = said.get((c, verdict), 0) + 1
    least = url_filter.MIN_SUPPORT * len(rows)
    rules = {(c, v): n / held[c] for (c, v), n in said.items() if n >= least and n / held[c] >= url_filter.MIN_CONFIDENCE}
    return {k: (s, said[k] / len(rows)) for k, s in rules.items() if not any(rules.get((p, k[1]), 0) >= s for j in range(1, len(k[0])) for p in combinations(k[0], j))}


def test_rules_equal_counted_subsets(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MIN_SUPPORT", 0.04)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        t = [f"t{i}" for i in range(7) if rng.random() < 0.4]
        t += ["twin=a", "twin=b", "twin=c"] if rng.random() < 0.3 else []
        t += ["pair=a", "pair=b"] if rng.random() < 0.3 else []
        sure = 0.95 if {"twin=a", "pair=a"} <= set(t) or {"t1", "t2", "t3"} <= set(t) else 0.4
        rows.append((t, "block" if rng.random() < sure else "allow"))
    got = {(tuple(r.rule_tokens), r.verdict): (r.confidence, r.support) for r in url_filter.mine(spark.createDataFrame(rows, ROWS).repartition(3)).collect()}
    want = brute(rows)
    assert want and got.keys() == want.keys() and any(len(k[0]) > 1 for k in want)
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_hosts_of_many_labels_are_mined_in_seconds(spark):
    deep = ".".join(f"l{i}" for i in range(15))
    urls = [f"https://{deep}.net/fr/{i}" for i in range(50)] + [f"https://h{i % 90}.example.com/en/{i}" for i in range(950)]
    urls += [f"https://{deep}.org/it/{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    at = time.time()
    got = {r.page_id: r.verdict for r in url_filter.judged(pages).collect()}
    assert time.time() - at < 30  # with a session that starts up
    assert {got[i] for i in range(1_000, 1_020)} == {"block"}  # by the labels that the hosts share
    table = spark.createDataFrame([(u,) for u in urls[:1_000]], "url string")
    h, p = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    rows = table.select(url_filter.tokens(F.col("url"), h, p).alias("tokens"), url_filter.listed(h, p).verdict.alias("verdict"))
    rules = {(tuple(r.rule_tokens), r.verdict) for r in url_filter.mine(rows).collect()}
    assert {((f"host=l{i}",), "block") for i in range(15)} <= rules


def test_rows_without_tokens_count(spark):
    rows = [([], "block")] * 50 + [(None, "block")] * 25 + [(["a", "a"], "allow")] * 25
    got = url_filter.mine(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.rule_tokens, r.verdict, r.confidence, r.support) for r in got] == [(["a"], "allow", 1.0, 0.25)]
    assert url_filter.mine(spark.createDataFrame([], ROWS)).count() == 0
