import pytest
from pyspark.sql import functions as F

from gistmill.operators import budget, compare, labels, sections, segment, validate, view, zoning
from gistmill.plans.config import SkimConfig


def test_segmentation(spark, rows):
    text = "Short. " + "This sentence is long enough to be a candidate here. And a second one that is long enough as well!\n" + "1234567890 " * 5
    pages = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, "x" * 900)], "doc_id long, page_index int, text string")
    got = rows(segment.candidates(pages), "doc_id", "nth", "text")
    assert [r[:2] for r in got] == [(1, 0), (1, 1), (3, 0)]
    assert len(got[2][2]) == 900


def test_null_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert segment.candidates(segment.lines(docs)).count() == 0
    assert segment.lines(docs).count() == 2


def test_chunks():
    place = lambda n, per=5: [("body", i // per) for i in range(n)]
    assert budget.chunk_ids([100, 100], place(2), 10_000) == [0, 0]
    lengths = [205 + len(str(i // 5)) for i in range(150)]
    where = [("a" if i < 75 else "b", i // 5) for i in range(150)]
    got = budget.chunk_ids(lengths, where, 1500)
    assert got == sorted(got) and max(got) > 0
    sizes = [got.count(i) for i in range(max(got) + 1)]
    assert sizes == [20] * 7 + [10]
    assert all(budget._cost([x for x, c in zip(lengths, got, strict=True) if c == i]) <= 1500 for i in set(got))
    assert budget.chunk_ids([158] * 8 + [160] * 8, [("intro", 0)] * 8 + [("methods", 0)] * 8, 600) == [0] * 8 + [1] * 8
    assert budget.chunk_ids([], [], 100) == []
    assert budget.chunk_ids([10_000], place(1), 100) == [0]


def test_chunks_do_not_depend_on_partitions(spark, rows):
    s = spark.createDataFrame([(d, i, i // 4, "x" * (50 + 7 * i % 90), "body") for d in range(4) for i in range(40)], "doc_id long, sent_id long, page_index int, text string, section string")
    one = rows(budget.chunks(s.repartition(1), 300), "doc_id", "sent_id", "chunk_id", "local_id")
    assert one == rows(budget.chunks(s.repartition(8), 300), "doc_id", "sent_id", "chunk_id", "local_id")
    joined = budget.chunks(s, 300)
    assert joined.count() == s.count()
    assert budget.chunk_guard(joined, 300).count() == 0


def test_bands_are_contiguous(spark):
    s = spark.createDataFrame([(1, i, i // 4, "x" * 60, "body") for i in range(40)], "doc_id long, sent_id long, page_index int, text string, section string")
    plan = budget.band_plan(s).withColumn("bands", F.lit(8))
    got = [r.n for r in budget.bands(s, plan).groupBy("band_id").agg(F.count("*").alias("n")).orderBy("band_id").collect()]
    assert got == [5] * 8
    units = budget.banded_chunks(s, 100)
    assert units.count() == 40 and units.agg(F.max("unit_id")).first()[0] >= 7


def test_budget_numbers():
    assert SkimConfig().selection_budget == 4916
    assert SkimConfig(context_tokens=100).context_limit == 2048
    assert SkimConfig(context_tokens=100_000).selection_budget == 94_000


def test_sections(spark, rows):
    pages = [(1, 0, "x"), (1, 1, "Introduction here"), (1, 2, "y"), (1, 3, "2. Methods"), (1, 4, "z")]
    got = rows(sections.fill_sections(spark.createDataFrame(pages, "doc_id long, page_index int, text string")), "page_index", "section")
    assert [s for _, s in got] == ["body", "introduction", "introduction", "methods", "methods"]


def test_filter_keeps_all_when_nothing_is_left(spark, rows):
    s = spark.createDataFrame([(1, 0, "references"), (1, 1, "references"), (2, 0, "references"), (2, 1, "body")], "doc_id long, sent_id long, section string")
    assert rows(sections.keep_candidates(s), "doc_id", "sent_id") == [(1, 0), (1, 1), (2, 1)]


def test_front_matter(spark, rows):
    s = spark.createDataFrame([(1, 0, 0, "a" * 50, "body"), (1, 1, 0, "b" * 130, "body"), (1, 2, 0, "c" * 50, "body"), (1, 3, 1, "d" * 50, "body")], "doc_id long, sent_id long, page_index int, text string, section string")
    assert [r[1] for r in rows(sections.mark_front_matter(s), "sent_id", "section")] == ["front matter", "body", "body", "body"]


def _page_lines(spark, pages):
    data = [(1, p, i, 10 * i, 10 * i + 10, float(b), t) for p, ls in enumerate(pages) for i, (b, t) in enumerate(ls)]
    return spark.createDataFrame(data, "doc_id long, page_index int, line_no int, start_char int, end_char int, baseline double, text string")


def test_furniture_rules(spark):
    head = lambda n, total: [[(700, f"Running head {p}")] if p < n else [(600, f"other text {chr(97 + p)}")] for p in range(total)]
    count = lambda pages: zoning.furniture(_page_lines(spark, pages)).count()
    assert [count(head(10, 10)), count(head(2, 10)), count(head(3, 10)), count(head(3, 11)), count(head(2, 2))] == [10, 0, 3, 0, 0]
    assert count([[(700 if p % 2 else 300, "Running head")] for p in range(10)]) == 0


def test_furniture_ranges_are_half_open(spark, rows):
    ranges = spark.createDataFrame([(1, 0, 10, 20)], "doc_id long, page_index int, start_char int, end_char int")
    s = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 9, 11), (1, 0, 20, 30), (1, 1, 10, 20)], "doc_id long, page_index int, start_char int, end_char int")
    assert rows(zoning.without_furniture(s, ranges)) == [(1, 0, 0, 10), (1, 0, 20, 30), (1, 1, 10, 20)]


def _replies(spark, *raw, count=4, most=0, empty=False):
    r = spark.createDataFrame([(i, x, count, most, empty) for i, x in enumerate(raw)], "n int, json string, sentence_count int, max_items int, allow_empty boolean")
    return validate.entries(r, "selected", "sentences", bare=True)


def test_selection(spark, rows):
    known = labels.default_labels(spark)
    r = _replies(spark, '{"selected":[{"id":0,"label":"goal","importance":0.15},{"id":2,"label":"Method","importance":3},{"id":2,"label":"goal"},{"id":7,"label":"goal"},{"id":null,"label":"goal"},{"id":1,"label":"x"}]}', '{"selected":[]}', "{}", '[{"id":"1.9","label":" RESULT ","weight":"0.3"}]')
    got = validate.selection(r, known, ["n"])
    assert rows(got) == [(0, 0, "goal", 0.15), (0, 2, "method", 1.0), (3, 1, "result", 0.3)]
    assert rows(validate.accepted(r, got, ["n"])) == [(0, True), (1, False), (2, False), (3, True)]
    r = _replies(spark, '{"selected":[]}', empty=True)
    assert rows(validate.accepted(r, validate.selection(r, known, ["n"]), ["n"])) == [(0, True)]


def test_selection_limit(spark, rows):
    r = _replies(spark, '{"selected":[{"id":0,"label":"goal","importance":0.2},{"id":1,"label":"goal","importance":0.9},{"id":3,"label":"goal","importance":0.5}]}', most=2)
    assert rows(validate.selection(r, labels.default_labels(spark), ["n"]), "id") == [(1,), (3,)]
    assert rows(validate.adaptive_selection(r, ["n"]), "id") == [(1,), (3,)]


def test_reduce_coerces_nulls(spark, rows):
    raw = '{"core":[{"id":null,"role":"Problem","importance":null},{"id":1,"role":"central_claim"},{"id":2,"role":"significance"},{"id":3,"role":"evidence","importance":"2"}]}'
    r = spark.createDataFrame([(1, raw, 4, 4)], "n int, json string, sentence_count int, max_items int")
    got = {i: (role, x) for _, i, role, x in rows(validate.reduced(validate.entries(r, "core", "selected"), ["n"]))}
    assert got[0] == ("problem", 0.0) and got[3] == ("evidence", 1.0) and len(got) == 4


def test_loose_json():
    f = validate.loose_json_text
    assert f('a {"x": 1} b {"y": "}"} c') == '{"y": "}"}'
    assert f("[1, 2]") == "[1, 2]" and f("nothing") is None and f(None) is None
    assert f('{"a": [1, {"b": 2}]} trailing {broken') == '{"a": [1, {"b": 2}]}'


def test_summary(spark):
    df = spark.createDataFrame([("  too   short ",), ("long enough  to be\n a summary",)], "s string")
    assert [r[0] for r in df.select(validate.summary_text(F.col("s"))).collect()] == [None, "long enough to be a summary"]


def test_label_sets(spark, rows):
    sets = spark.createDataFrame([(1, '{"labels":[{"key":"A1","name":"A","description":"d"},{"key":"a","name":"B","description":"d"},{"key":"b","name":"C","description":"d"}]}'), (2, '{"labels":[{"key":"a","name":"A","description":"d"},{"key":"A","name":"B","description":"d"}]}'), (3, '{"labels":[{"key":"a","name":"A"},{"key":"b","name":"B","description":"d"}]}')], "n int, json string")
    assert rows(labels.discovered_labels(sets, ["n"]), "n", "key", "ord") == [(1, "a", 0), (1, "b", 1)]
    custom = spark.createDataFrame([(1, '[{"key":"a","name":"A","examples":["x"," ","y","z","w"]}]'), (2, '[{"key":"a","name":"A"},{"key":"!","name":"B"}]'), (3, "nope")], "n int, json string")
    got = labels.custom_labels(custom, ["n"]).collect()
    assert [(r.n, r.key, r.examples) for r in got] == [(1, "a", ["x", "y", "z"])]


def test_label_fold():
    known = []
    names = ["Core Claim", "core claim", "Evidence", *(f"kind {c}" for c in "abcdef"), "evidences", "zzz"]
    got = [labels.resolve_label(n, known) for n in names]
    assert got[:3] == ["coreclaim", "coreclaim", "evidence"] and len(known) == 8
    assert got[-2:] == ["evidence", "coreclaim"]


def _classified(spark):
    data = [(1, 0, 0, "goal", 0.5, False), (1, 1, 0, "goal", 0.49, True), (1, 2, 1, "none", 0.9, False), (2, 0, 0, "goal", 0.9, True), (2, 1, 1, "method", 0.9, False)]
    s = spark.createDataFrame(data, "doc_id long, sent_id long, page_index int, label string, confidence double, core boolean")
    return s.withColumn("text", F.lit("text of it")).withColumn("start_char", F.col("sent_id").cast("int") * 10).withColumn("end_char", F.col("start_char") + 9)


def test_views(spark, rows):
    s = _classified(spark)
    assert rows(view.view(s), "doc_id", "sent_id") == [(1, 0), (2, 0)]
    assert rows(view.view(s, False), "doc_id", "sent_id") == [(1, 0), (2, 0), (2, 1)]
    shown = view.highlights(view.view(s, False), labels.default_labels(spark), ["goal"])
    assert rows(shown, "doc_id", "label_name") == [(2, "Method")]
    assert rows(view.counts_by_label(view.view(s, False))) == [(1, "goal", 1), (2, "goal", 1), (2, "method", 1)]
    a = view.annotation_rows(view.highlights(view.view(s, False), labels.default_labels(spark)))
    assert view.not_saved(a, a).count() == 0 and view.not_saved(a, a.limit(1)).count() == 2


def test_core_is_within_the_kept(spark, rows):
    s = _classified(spark)
    core = spark.createDataFrame([(1, 0, 0.8), (9, 9, 0.1)], "doc_id long, sent_id long, importance double")
    got = rows(validate.mark_core(s, core), "doc_id", "sent_id", "core", "confidence")
    assert got[0] == (1, 0, True, 0.8) and sum(r[2] for r in got) == 1 and len(got) == 5


def test_comparison(spark, rows):
    e = spark.createDataFrame([(1, "a", "a text of nineteen!", 0), (1, "a", "this one is contained in the other", 1), (1, "b", "here this one is contained in the other set", 2), (2, "b", "this one is contained in the other", 0)], "doc_id long, set_name string, text string, page int")
    assert rows(compare.overlap(e, "a", "b", F.lower("text"))) == [(1, 2, 0.5)]
    assert rows(compare.overlap(e, "a", "none", F.lower("text"))) == [(0, 2, 0.0)]
    assert rows(compare.overlap(e, "none", "a", F.lower("text"))) == [(0, 0, 0.0)]
    got = compare.set_stats(e, F.lit(3)).where("set_name = 'a'").first()
    assert (got.n, got.pages, got.first_third, got.second_third, got.last_third) == (2, 2, 1, 1, 0)


def test_report(spark, rows):
    e = spark.createDataFrame([(1, "a", "this one is contained in the other", 0), (1, "b", "here this one is contained in the other set", 1)], "doc_id long, set_name string, text string, page int")
    got = {(m, s): v for m, s, v in rows(compare.report(e, "a", "b", F.lower("text")))}
    assert got["n", "a"] == 1 and got["share in b", "a"] == 1 and len(got) == 14


def test_status_lines(spark):
    s = spark.createDataFrame([("complete", 24, 9, 12, 11, 812, 1000, 50), ("partial", 0, 0, 12, 0, 40, 0, 0), ("none", 0, 0, 0, 0, 0, 0, 0)], "state string, selections int, pages_covered int, page_span int, core_count int, considered int, tokens_in int, tokens_out int")
    got = [r[0] for r in s.select(view.summary_line(F.struct("*")).alias("x")).collect()]
    assert got[0] == "✓ Complete — 24 highlights across 9/12 pages · 11 core · 1,000 in / 50 out tokens"
    assert got[1] == "◐ Partial — 40 sentences processed. Generate resumes." and got[2] is None


def test_label_modes(spark):
    assert labels.configured_labels(spark, "auto", "") is None
    assert labels.configured_labels(spark, "custom", "nope").count() == 4
    assert [r.key for r in labels.configured_labels(spark, "custom", '[{"key":"x","name":"X"}]').collect()] == ["x"]


def test_complete_runs_and_order(spark, rows):
    shown = spark.createDataFrame([(1, 1, 5), (1, 0, 9), (2, 0, 0)], "doc_id long, page_index int, start_char int")
    state = spark.createDataFrame([(1, True), (2, False)], "doc_id long, complete boolean")
    got = view.in_order(view.of_complete_runs(shown, state)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 9), (1, 1, 5)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('{"selected":[{"id":0,"label":"goal"}]', None),
        ('so {"a": 1} and then [2', '{"a": 1}'),
        ('a "quoted { bracket" before {"a": 2}', '{"a": 2}'),
        ('an open "quote {"a": 3}', None),
        ('{"a": NaN}', None),
        ("first [1] then [Infinity]", "[1]"),
        ("{" * 20_000, None),
    ],
)
def test_replies_cut_short_and_quotes_outside(given, want):
    assert validate.loose_json_text(given) == want
