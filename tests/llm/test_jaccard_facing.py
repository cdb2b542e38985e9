"""Members that link with a head and those near it meet once for the head, however many keys they share."""

import pytest

from gistmill.llm import jaccard_join


@pytest.mark.parametrize("block", [512, 2])
def test_a_pair_meets_once_for_a_head(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "FREQUENT_COUNT", 1 << 30)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [f"w{i}" for i in range(1500)]  # long texts: short bitmaps tell no pair apart
    texts = [" ".join(base)]
    for i, changes in enumerate([10] * 4 + [60] * 4):  # four link with the first text, four are near it
        w = list(base)
        for j in range(changes):
            w[1500 // changes * j + 2 * i] = f"n{i}x{j}"
        texts.append(" ".join(w))
    met = []

    def counted(*sides, blocks=jaccard_join._in_blocks):
        met.append(blocks(*sides))
        return met[-1]

    monkeypatch.setattr(jaccard_join, "_in_blocks", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.jaccard_join(docs, k=5, percent=80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 0 if i < 5 else i) for i in range(9)}
    assert 4 * 4 <= met[-1].count() < 2 * 4 * 4  # a pair may have a second head
