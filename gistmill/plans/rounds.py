"""Long works read live: labels grow from unit to unit, all documents at once.

Round n asks unit n of every document that has one, with the labels that its units
before n brought up, so a selector is called once a round and there are as many
rounds as the longest document has units.  A round's replies, and its selections with
the labels after it, are tables under `path`; a round counts once the latter are
written.  A run that stops begins again at the first round that does not count, and
replies that are there already are not asked for again.  A folder belongs to its
sentences and budget: others get another.

Each document's units, labels (at most eight) and selections of a unit are small; no
step gathers more.  A unit without a valid reply is empty; the run goes on.  Empty
documents have no units and no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gistmill.operators import budget, labels, prompts, select, validate
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import Run, evolved, standing, unit_sizes

REPLY = "doc_id long, chunk_id int, attempt int, raw string, usage_in long, usage_out long"
_FOLDED = f"doc_id long, named array<struct<id:bigint,key:string,name:string,importance:double>>, known {labels.KNOWN}"


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _kept(path: str, make: Callable[[], DataFrame], schema: str | StructType, by: str | None = None) -> DataFrame:
    """The table at path, which is made and written unless it is there."""
    spark = SparkSession.active()
    if not _there(spark, path):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _folder(sents: DataFrame, config: SkimConfig, path: str) -> str:
    mark = sents.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id", "sent_id", "page_index", "section", "text")).alias("x")).first()
    return f"{path.rstrip('/')}/{config.selection_budget}-{mark.n}-{(mark.x or 0) & (1 << 64) - 1:016x}"


def ask_round(units: DataFrame, known: DataFrame, selector: select.Selector) -> DataFrame:
    """Replies to one unit of each document.  known: doc_id, unit_id, max_items, known
    (KNOWN); requests carry `user` and `known`."""
    names = F.when(F.size("known") > 0, F.array_join(F.transform("known", lambda k: k["name"]), ", "))
    told = known.select("doc_id", "unit_id", "max_items", F.col("known").alias("labels"), names.alias("known"))
    asked = prompts.adaptive_requests(units, told, F.col("max_items")).withColumnsRenamed({"labels": "known", "unit_id": "chunk_id"})
    return selector.select(asked).select(*(F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in REPLY.split(", ")))


def read_round(unit: DataFrame, size: DataFrame, known: DataFrame, selector: select.Selector, at: str) -> DataFrame:
    """doc_id, known: the labels after this unit of each document that has it."""
    before = known.join(size, "doc_id")
    replies = _kept(f"{at}/replies", lambda: ask_round(unit, before, selector), REPLY)

    def folded() -> DataFrame:
        valid, _ = standing(replies.withColumnRenamed("chunk_id", "unit_id"), size)
        return labels.fold(valid, before.select("doc_id", "known"))

    return _kept(f"{at}/folded", folded, _FOLDED).select("doc_id", "known")


def grow(sents: DataFrame, config: SkimConfig, selector_of, path: str, *, most_rounds: int | None = None) -> Run:
    """The run of long works by a live selector, which selector_of makes from the units
    (doc_id, chunk_id, local_id, text and more).  most_rounds stops after so many new
    rounds; documents with units left are then not complete."""
    spark = sents.sparkSession
    here = _folder(sents, config, path)
    banded = budget.banded_chunks(sents, config.selection_budget)
    units = _kept(f"{here}/units", lambda: banded, banded.schema, by="unit_id")
    counted = unit_sizes(units, units)  # units hold all sentences
    sizes = _kept(f"{here}/sizes", lambda: counted, counted.schema)
    last = sizes.agg(F.max("unit_id")).first()[0]
    selector = selector_of(units.withColumnRenamed("unit_id", "chunk_id"))
    select.require_consent(selector, config.consent)
    known = sizes.select("doc_id").distinct().select("doc_id", F.array().cast(labels.KNOWN).alias("known"))
    asked, last_read = 0, -1
    for n in range(-1 if last is None else last + 1):
        at = f"{here}/round-{n:05d}"
        unit, size = units.where(F.col("unit_id") == n), sizes.where(F.col("unit_id") == n)
        if not _there(spark, f"{at}/folded"):
            if asked == most_rounds:
                break
            asked += 1
        known = read_round(unit, size, known, selector, at)
        last_read = n

    def rounds(name: str, schema: str) -> DataFrame:
        """A table of all rounds read, with chunk_id from its folder."""
        paths = [f"{here}/round-{i:05d}/{name}" for i in range(last_read + 1)]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows.withColumn("chunk_id", F.regexp_extract(F.input_file_name(), r"/round-(\d{5})/", 1).cast("int"))

    replies = rounds("replies", REPLY.replace("chunk_id int, ", "")).withColumnRenamed("chunk_id", "unit_id")
    done = sizes.where(F.col("unit_id") <= last_read)
    _, failed = standing(replies, done)
    named = rounds("folded", _FOLDED).select("doc_id", "chunk_id", F.inline("named"))
    return evolved(sents, config, units, sizes, named, failed, validate.token_usage(replies), done.select("doc_id", "unit_id"))


def label_sets(run: Run) -> DataFrame:
    """doc_id, labels (key, name, in the order they came up) of a run's documents."""
    first = run.classified.groupBy("doc_id", F.col("label").alias("key")).agg(F.min(F.struct("chunk_id", "local_id", F.col("label_name").alias("name"))).alias("first"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("first.chunk_id"), F.col("first.local_id"), "key", F.col("first.name").alias("name"))))
    return first.groupBy("doc_id").agg(F.transform(rows, lambda x: F.struct(x["key"].alias("key"), x["name"].alias("name"))).alias("labels"))
