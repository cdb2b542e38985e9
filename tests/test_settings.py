"""Settings that must reach the run: requests' contract, consent, hidden labels, annotation fields."""

import json

import pytest
from pyspark.sql import functions as F

from gistmill.operators import labels, select
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import annotations, skim, text_sentences

DOC = "This is a sentence long enough to be a candidate. And so is this second one, by a good margin."


class Outside(select.HeuristicSelector):
    sends_text = True


def test_requests_carry_system_text_and_schema(spark):
    label_set = labels.default_labels(spark)
    run = skim(text_sentences(spark.createDataFrame([(1, DOC), (2, DOC + "\n" + DOC), (3, None)], "doc_id long, text string")), SkimConfig(), label_set)
    got = {r.doc_id: r for r in run.requests.collect()}
    assert set(got) == {1, 2}
    keys = [r.key for r in label_set.orderBy("ord").collect()]
    for r in got.values():
        schema = json.loads(r.schema)["properties"]["selected"]
        assert schema["maxItems"] == r.max_items and schema["items"]["properties"]["label"]["enum"] == keys
        assert all(k in r.system for k in keys)
    assert got[2].max_items == 2 * got[1].max_items


def test_texts_leave_only_with_consent(spark):
    sents = text_sentences(spark.createDataFrame([(1, DOC)], "doc_id long, text string"))
    make = Outside(sents.withColumn("chunk_id", F.lit(0)).withColumn("local_id", F.col("sent_id").cast("int")))
    with pytest.raises(PermissionError):
        skim(sents, SkimConfig(), selector=make)
    assert skim(sents, SkimConfig(consent=True), selector=make).classified.count() == 2


def test_annotation_settings_reach_the_rows(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    label_set = labels.default_labels(spark)
    run = skim(text_sentences(docs), SkimConfig(), label_set)
    names = {r.key: r.name for r in label_set.collect()}
    shown = {names[r.label] for r in run.viewed.collect()}
    plain = annotations(run, SkimConfig(), label_set).collect()
    assert {r.comment for r in plain} == shown and all(not r.tags for r in plain)
    assert all(DOC[r.start_char : r.end_char] == r.text for r in plain) and len(plain) == 2
    tagged = annotations(run, SkimConfig(annotation_destination="tag", annotation_prefix=True), label_set).collect()
    assert all(r.comment == "" and r.tags[0].name.startswith("Skim: ") for r in tagged)
    hide = json.dumps([r.label for r in run.viewed.collect()])
    assert annotations(run, SkimConfig(hidden_labels=hide), label_set).count() == 0
