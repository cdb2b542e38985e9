from pyspark.sql import functions as F

from gistmill.operators import select
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import skim, skim_evolving
from gistmill.plans.resume import resume, shown

SENTS = "doc_id long, sent_id long, page_index int, start_char int, end_char int, text string, section string"
REPLY = "doc_id long, chunk_id int, attempt int, raw string, usage_in int, usage_out int"


def _docs(spark, lengths):
    docs = spark.createDataFrame([(d, f"document {d}") for d in lengths], "doc_id long, text string")
    rows = [(d, s, s // 4, 0, 40 + (s * 37) % 60, "x" * (40 + (s * 37 + d) % 60), "body") for d, n in lengths.items() for s in range(n)]
    return docs, spark.createDataFrame(rows, SENTS)


class Spoilt(select.HeuristicSelector):
    """Fails at chunk 2 of each document, and tells how many requests came."""

    asked = 0

    def select(self, requests):
        Spoilt.asked = requests.count()
        good = super().select(requests)
        return good.withColumn("raw", F.when(F.col("chunk_id") == 2, "no").otherwise(F.col("raw")))


class Counted(select.HeuristicSelector):
    asked = 0

    def select(self, requests):
        Counted.asked = requests.count()
        return super().select(requests)


def test_a_stopped_run_ends_as_one_that_never_stopped(spark, tmp_path, rows):
    docs, sents = _docs(spark, {1: 3, 2: 150, 3: 260, 4: 0})
    path, config = f"file://{tmp_path}/state", SkimConfig(context_tokens=2048)
    whole = skim(sents, config)
    chunks = whole.requests.count()
    first = resume(docs, sents, config, path, Spoilt)
    assert Spoilt.asked == chunks
    assert rows(first, "doc_id", "complete") == [(1, True), (2, False), (3, False), (4, True)]
    sizes = {(r.doc_id, r.chunk_id): r.sentence_count for r in whole.requests.collect()}
    assert {r.doc_id: r.classified_count for r in first.collect()} == {1: 3, 2: sizes[2, 0] + sizes[2, 1], 3: sizes[3, 0] + sizes[3, 1], 4: 0}
    # a budget of another size does not move the chunks of a run that has begun
    second = resume(docs, sents, SkimConfig(context_tokens=2048, chunk_budget=1100), path, Counted)
    assert Counted.asked == chunks - 5
    assert second.where(~F.col("complete")).count() == 0
    got = second.select("doc_id", F.inline("sentences"))
    assert rows(got, "doc_id", "sent_id", "label", "confidence") == rows(whole.classified, "doc_id", "sent_id", "label", "confidence")
    assert all(r.tokens_in >= w.tokens_in for r, w in zip(second.where("doc_id < 4").orderBy("doc_id").collect(), whole.state.orderBy("doc_id").collect(), strict=True))
    resume(docs, sents, config, path, Counted)
    assert Counted.asked == 0
    resume(docs.where("doc_id = 3"), sents, config, path, Counted, regenerate=True)
    assert Counted.asked == sum(d == 3 for d, _ in sizes)


def test_equal_texts_are_asked_once(spark, tmp_path, rows):
    docs, sents = _docs(spark, {1: 6})
    docs = docs.unionByName(docs.withColumn("doc_id", F.lit(9).cast("long")))
    sents = sents.unionByName(sents.withColumn("doc_id", F.lit(9).cast("long")))
    got = resume(docs, sents, SkimConfig(), f"file://{tmp_path}/state", Counted)
    assert Counted.asked == 1
    assert [r[1] for r in rows(got, "doc_id", "classified_count")] == [6, 6]


def test_label_modes_reduce_summary_and_hidden_labels(spark, tmp_path, rows):
    docs, sents = _docs(spark, {1: 8, 2: 8})
    said = '{"selected":[' + ",".join(f'{{"id":{i},"label":"{k}"}}' for i, k in enumerate(["Plot", "cast", "plot", "cast", "plot", "cast"])) + "]}"
    replies = spark.createDataFrame([(1, 0, 0, said, 7, 2), (2, 0, 0, said.replace("cast", "goal"), 7, 2)], REPLY)
    found = spark.createDataFrame([(1, '{"labels":[{"key":"plot","name":"Plot","description":"p"},{"key":"cast","name":"Cast","description":"c"}]}'), (2, "[]")], "doc_id long, json string")
    core = '{"core":[' + ",".join(f'{{"id":{i},"role":"{r}"}}' for i, r in enumerate(["problem", "central_claim", "evidence", "significance"])) + "]}"
    config = SkimConfig(label_mode="auto", hidden_labels='["cast"]')
    notes = spark.createDataFrame([(1, 0, '{"summary": "a summary that is long enough"}')], "doc_id long, attempt int, raw string")
    got = resume(docs, sents, config, f"file://{tmp_path}/state", lambda c: select.ReplaySelector(replies), discovered=found, reduce_replies=spark.createDataFrame([(1, core)], "doc_id long, raw string"), summary_replies=notes)
    by = {r.doc_id: r for r in got.collect()}
    assert [x.key for x in by[1].labels] == ["plot", "cast"] and (by[1].reduced, by[1].core_count) == (True, 4)
    assert by[1].tldr == "a summary that is long enough" and by[2].tldr is None
    assert {x.label for x in by[2].sentences} == {"goal"}  # its own set is the default one
    assert rows(shown(got.where("doc_id = 1"), config), "sent_id", "label_name") == [(0, "Plot"), (2, "Plot")]


def test_long_works_go_by_labels_that_grow(spark, tmp_path, rows):
    docs, sents = _docs(spark, {1: 12, 2: 8})
    kinds = spark.createDataFrame([(1, "book", False), (2, None, None)], "doc_id long, item_type string, is_epub boolean")
    replies = spark.createDataFrame([(1, 0, 0, '{"selected":[{"id":0,"label":"Turn"}]}', 1, 1), (1, 1, 0, '{"selected":[{"id":1,"label":"Cast"}]}', 1, 1)], "doc_id long, unit_id int, attempt int, raw string, usage_in int, usage_out int")
    config, path = SkimConfig(label_mode="auto"), f"file://{tmp_path}/state"
    assert rows(resume(docs, sents, config, path, items=kinds), "doc_id", "complete") == [(1, False), (2, True)]
    got = {r.doc_id: r for r in resume(docs, sents, config, path, items=kinds, adaptive_replies=replies).collect()}
    assert got[1].complete and [x.key for x in got[1].labels] == ["turn", "cast"] and [x.label for x in got[1].sentences] == ["turn", "cast"]
    asked = {r.chunk_id: r.user.split("\n")[0].split(": ")[1] for r in skim_evolving(sents.where("doc_id = 1"), config, replies).requests.collect()}
    assert asked[0] == "none yet" and asked[1] == "Turn" and asked[2] == "Turn, Cast"
