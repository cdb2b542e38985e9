"""Secret scans: harmless text stays, recall by length, long runs, shapes of input;
labelled samples with long texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.llm import common, kernel, secrets

DIGITS = "0123456789"
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + DIGITS
WORDS = "the market of winter river house morning council report energy music travel minister football garden science history".split()
SF = "/root/testdata/sf0.001"


def picker(seed):
    rng = np.random.default_rng(seed)
    return (lambda c, k: "".join(rng.choice(list(c), k))), (lambda: str(rng.choice(WORDS)))


HARMLESS = {
    "url": lambda p, w: f"https://www.{w()}news.com/20{p(DIGITS, 2)}/0{p('123456789', 1)}/{w()}-{w()}-{w()}-{w()}",
    "uuid": lambda p, w: "-".join(p("0123456789abcdef", i) for i in (8, 4, 4, 4, 12)),
    "isbn": lambda p, w: f"978-{p(DIGITS, 1)}-{p(DIGITS, 3)}-{p(DIGITS, 5)}-{p(DIGITS, 1)}",
    "phone": lambda p, w: f"+{p(DIGITS, 2)}-{p(DIGITS, 3)}-{p(DIGITS, 4)}-{p(DIGITS, 4)}",
    "card": lambda p, w: p(DIGITS, 16),
    "image": lambda p, w: f"IMG_20{p(DIGITS, 6)}_{p(DIGITS, 6)}",
    "compound": lambda p, w: w() + w() + w() + w(),
    "camel": lambda p, w: w().title() + w().title() + w().title(),
}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return secrets.train(ordinary=secrets.ordinary_runs(docs))


def marked(model, texts):
    return np.mean([any(k == 3 for _, _, k, _ in s) for s in secrets.scan(kernel.strings(pa.array(texts)), model)])


@pytest.mark.parametrize("kind", HARMLESS)
def test_harmless_runs_stay(model, kind):
    pick, word = picker(1)
    assert marked(model, [f"{word()} {word()} {HARMLESS[kind](pick, word)} {word()}" for _ in range(400)]) <= 0.02


def test_recall_by_length(model):
    pick, word = picker(2)
    found = {k: marked(model, [f"{word()} key {pick(ALNUM, k)} {word()} {word()}" for _ in range(400)]) for k in (8, 10, 12, 14, 16, 20, 32)}
    assert all(found[k] >= 0.95 for k in (16, 20, 32)) and all(found[k] >= 0.6 for k in (8, 10, 12, 14)), found


def test_documents_keep_their_words(spark, model):
    """Of whole documents outside the sample too, few runs are marked."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.scanned(docs, model).select(F.explode(F.split("spans", ",")).alias("s")).where("s like 'model:%'").count()
    assert got <= 0.02 * docs.count()


def test_long_runs_are_pooled_in_windows(model):
    pick, _ = picker(3)
    some = pick(ALNUM, 10_000) * 60  # over two windows
    for size in (secrets.BLOCK - 1, secrets.BLOCK, secrets.BLOCK + 1, secrets.BLOCK + secrets.WIDTH, len(some)):
        one = some[:size].encode()
        whole = model.pools([one])[:2]
        for a, b in zip(whole, model.long_pools(one), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9)
    (spans,) = secrets.scan(kernel.strings(pa.array([some])), model)
    assert [(s, e) for s, e, k, _ in spans if k == 3] == [(0, len(some))]


def test_a_run_of_twenty_megabytes(model):
    pick, _ = picker(4)
    text = "x " + pick(ALNUM, 20_000) * 1_000 + " y"
    (spans,) = secrets.scan(kernel.strings(pa.array([text])), model)
    assert (2, len(text) - 2) in [(s, e) for s, e, *_ in spans]


def test_short_candidates_mix_letters_and_digits():
    texts = ["alphabetic 20200101 ab3defgh abCdefgh Abcdefgh ABCDEFGH abcdefg1 a1b2c3d a-b-c-d-1"]
    ((_, runs),) = secrets.candidates(*kernel.buffers(kernel.strings(pa.array(texts))))
    assert [texts[0][s:e] for s, e in runs] == ["ab3defgh", "abCdefgh", "abcdefg1", "a-b-c-d-1"]


def test_ordinary_runs_and_findings_of_odd_rows(spark, model):
    key = "Zk3uQ9rT1vXw7LmP2sBd"
    rows = [(1, f"é the key {key} é", 7), (1, f"again {key}", 8), (None, f"no id {key}", 9), (2, None, 1), (3, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans int")
    runs = secrets.ordinary_runs(docs)
    assert [(b, y) for _, b, _, y in runs] == [(key, 0)]
    assert secrets.ordinary_runs(docs.limit(0)) == [] and secrets.findings(docs.limit(0), model).count() == 0
    got = secrets.findings(docs, model).collect()
    assert sorted((str(r.doc_id), r.start, r.end, r.found) for r in got) == [("1", 6, 26, key), ("1", 10, 30, key), ("None", 6, 26, key)]
    assert secrets.scanned(docs, model).count() == 5  # a clashing column


def test_a_long_text_costs_the_sample_no_other_row(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_BYTES", 10_000)
    data = [(i, "w" * (11_000 if i in (3, 4) else 20)) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id int, quality int")
    rows, totals = common.labelled_sample(docs, labels, "quality", 1_000)
    kept = {r.doc_id for r in rows.collect()}
    inside = {r.doc_id for r in labels.where(common.fold(F.col("doc_id")) != 0).collect()}
    assert kept == inside - {3, 4} and sum(totals.values()) == len(inside)
    alone, _ = common.labelled_sample(docs.where("doc_id in (3, 4)"), labels, "quality", 1_000)
    assert {r.doc_id for r in alone.collect()} == inside & {3, 4}
