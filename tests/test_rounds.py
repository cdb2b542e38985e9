"""Labels that grow, asked live: against replayed replies, stopped, resumed and failing."""

from pyspark.sql import functions as F

from gistmill.operators import budget, labels
from gistmill.plans import rounds
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import skim_evolving

SENTS = "doc_id long, sent_id long, page_index int, start_char int, end_char int, text string, section string"
NAMES = ["Turning Point", "cast", "Money", "war", "Peace", "The Sea", "law", "Trade", "seaside", "zebra", "WARFARE", "123", "turning point"]


class Live:
    """Two picks a unit, named by what is known so far; every fifth unit fails."""

    calls = 0

    def __init__(self, units):
        pass

    def select(self, requests):
        Live.calls += 1
        n = F.size("known") * 3 + F.col("chunk_id") + F.col("doc_id")
        name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), ((n + k) % len(NAMES) + 1).cast("int"))
        good = F.concat(F.lit('{"selected":[{"id":0,"label":"'), name(0), F.lit('"},{"id":1,"label":" '), name(7), F.lit(' ","importance":0.9}]}'))
        raw = F.when((F.col("chunk_id") + F.col("doc_id")) % 5 == 4, "no").otherwise(good)
        return requests.select("doc_id", "chunk_id", F.lit(0).alias("attempt"), raw.alias("raw"), F.lit(2).alias("usage_in"), F.length("user").alias("usage_out"))


def _sents(spark, lengths):
    rows = [(d, s, s // 3, 0, 60, f"Sentence {s} of book {d} " + "x" * 40, "body") for d, n in lengths.items() for s in range(n)]
    return spark.createDataFrame(rows, SENTS)


def _all(run, rows):
    return (rows(run.classified, "doc_id", "chunk_id", "sent_id", "label", "label_name", "confidence"), rows(run.failed, "doc_id", "chunk_id"), rows(run.requests, "doc_id", "chunk_id", "sentence_count", "max_items", "user"), rows(run.state, "doc_id", "complete", "classified_count", "page_span", "tokens_in", "tokens_out"))


def test_live_rounds_equal_replayed_replies(spark, tmp_path, rows):
    sents, config = _sents(spark, {1: 7, 2: 40, 3: 20}), SkimConfig()
    Live.calls = 0
    run = rounds.grow(sents, config, Live, f"file://{tmp_path}/a")
    units = budget.banded_chunks(sents, config.selection_budget).agg(F.max("unit_id") + 1).first()[0]
    assert Live.calls == units > 3
    replies = spark.read.parquet(*(str(p) for p in sorted(tmp_path.glob("a/*/round-*/replies"))))
    replayed = skim_evolving(sents, config, replies.withColumnRenamed("chunk_id", "unit_id"))
    want = _all(run, rows)
    assert want == _all(replayed, rows)
    assert len(want[1]) > 1 and len(want[0]) > 10
    sets = {r.doc_id: [x.key for x in r.labels] for r in rounds.label_sets(run).collect()}
    assert all(len(v) == len(set(v)) <= labels.MOST_EVOLVING for v in sets.values()) and max(map(len, sets.values())) > 3


def test_a_run_stopped_between_rounds_goes_on(spark, tmp_path, rows):
    sents, config = _sents(spark, {1: 7, 2: 20}), SkimConfig()
    whole = _all(rounds.grow(sents, config, Live, f"file://{tmp_path}/whole"), rows)
    path, Live.calls = f"file://{tmp_path}/parts", 0
    part = rounds.grow(sents, config, Live, path, most_rounds=2)
    assert Live.calls == 2
    assert part.classified.agg(F.max("chunk_id")).first()[0] <= 1
    assert {r.doc_id: r.complete for r in part.state.collect()} == {1: False, 2: False}
    assert part.requests.agg(F.max("chunk_id")).first()[0] == 1
    assert _all(rounds.grow(sents, config, Live, path), rows) == whole and Live.calls == 3


def test_replies_that_are_there_are_not_asked_for_again(spark, tmp_path, rows):
    import shutil

    sents, config = _sents(spark, {2: 13}), SkimConfig()
    first = _all(rounds.grow(sents, config, Live, f"file://{tmp_path}"), rows)
    shutil.rmtree(next(tmp_path.glob("*/round-00001/folded")))  # as if the run had died here
    Live.calls = 0
    assert _all(rounds.grow(sents, config, Live, f"file://{tmp_path}"), rows) == first and Live.calls == 0
    # other sentences do not meet these tables
    other = rounds.grow(_sents(spark, {2: 14}), config, Live, f"file://{tmp_path}")
    assert Live.calls > 0 and other.state.first().classified_count == 14


def test_no_documents(spark, tmp_path):
    run = rounds.grow(spark.createDataFrame([], SENTS), SkimConfig(), Live, f"file://{tmp_path}")
    assert run.classified.count() == run.state.count() == run.failed.count() == 0


def test_fold_equals_the_loop(spark):
    names = [*NAMES, "", "ÉTÉ", "a very long label name that goes on", "Zebra ", "Sea"]
    picks = [(d, i, names[(d * 7 + i * 5) % len(names)] or "x", 0.5) for d in range(6) for i in range(14)]
    known = spark.createDataFrame([(d, [("war", "War")] if d % 2 else []) for d in range(7)], f"doc_id long, known {labels.KNOWN}")
    got = {r.doc_id: r for r in labels.fold(spark.createDataFrame(picks, "doc_id long, id long, label string, importance double"), known).collect()}
    for d in range(7):
        have = [("war", "War")] if d % 2 else []
        keys = [labels.resolve_label(n, have) for doc, _, n, _ in picks if doc == d]
        assert [x.key for x in got[d].named] == keys and [tuple(x) for x in got[d].known] == have
        assert [x.name for x in got[d].named] == [dict(have)[k] for k in keys]
