"""The pipeline's stages in order, each against its own input, and the registered queries."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from gistmill.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).cache()
        assert out.count() <= docs.count(), name
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert out.count() == docs.count()


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    cur = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == want


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
