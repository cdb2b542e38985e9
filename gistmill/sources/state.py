"""Run state: a Parquet table in buckets by the head of the cache key, and its key.

Columns: cache_key, prompt_version, doc_id, complete, classified_count, page_span,
tokens_in, tokens_out, reduced, core_count, chunk_budget, saved_keys, tldr, labels,
sentences (array of structs).  Writing replaces the rows of the keys written, and
touches their buckets only; one run writes at a time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gistmill.functions import vocab

SENTENCE = "struct<sent_id:long,page_index:int,start_char:int,end_char:int,text:string,section:string,label:string,confidence:double,core:boolean>"
STATE = (
    "doc_id long, prompt_version int, complete boolean, classified_count int, page_span int, tokens_in long, tokens_out long, reduced boolean, "
    f"core_count int, chunk_budget int, saved_keys array<string>, tldr string, labels array<struct<key:string,name:string,color:string>>, sentences array<{SENTENCE}>, cache_key string"
)

_COLUMNS = ["doc_id", "prompt_version", "complete", "classified_count", "page_span", "tokens_in", "tokens_out", "reduced", "core_count", "chunk_budget", "saved_keys", "tldr", "labels", "sentences", "cache_key"]


#: Characters of the key that name a bucket: 4,096 folders for hexadecimal keys.
BUCKET_CHARS = 3


def _bucket() -> Column:
    return F.concat(F.lit("h"), F.substring("cache_key", 1, BUCKET_CHARS)).alias("bucket")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of a run, in spark.checkpoint.dir, which driver and
    executors share; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gistmill-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cache_key(text: Column, provider: str, model: str, mode: str, label_keys: list[str]) -> Column:
    """SHA-256 of file hash, provider, model, mode, label keys and version."""
    parts = [F.sha2(F.encode(text, "UTF-8"), 256), *map(F.lit, (provider, model, mode, ",".join(label_keys), f"v{vocab.PROMPT_VERSION}"))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def config_fingerprint(*parts: str) -> Column:
    """A digest of the whole configuration, label texts and budget included."""
    return F.sha2(F.concat_ws("|", *map(F.lit, parts)), 256)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State rows of this prompt version; a missing table is empty.  A missing
    `complete` counts as true, a missing count as the number of sentences."""
    try:
        rows = spark.read.schema(STATE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STATE)
    rows = rows.where((F.col("prompt_version") == vocab.PROMPT_VERSION) & F.col("labels").isNotNull())
    return rows.withColumn("complete", F.coalesce("complete", F.lit(True))).withColumn("classified_count", F.coalesce("classified_count", F.size("sentences")))


def write_state(rows: DataFrame, path: str) -> None:
    """Replace the rows of the keys in rows; other keys stay.  Rows are read twice, so
    they should come from a written table."""
    new = rows.select(*_COLUMNS)
    try:
        old = rows.sparkSession.read.schema(f"{STATE}, bucket string").parquet(path)
        old = old.join(new.select(_bucket()).distinct(), "bucket", "left_semi").join(new.select("cache_key"), "cache_key", "left_anti")
        new = new.unionByName(old.select(*_COLUMNS))
    except AnalysisException:  # nothing written yet
        pass
    new = new.repartitionByRange("cache_key").select("*", _bucket())
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def delete_state(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Remove the rows of some keys.  What is left, rows of other versions included, is
    written beside; then the folders change places, so a failure before loses nothing.
    Without a table there is nothing to do."""
    try:
        left = spark.read.schema(STATE).parquet(path).join(keys.select("cache_key").distinct(), "cache_key", "left_anti")
    except AnalysisException:
        return
    left.select(*_COLUMNS, _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}.next")
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at(f"{path}.old"), True)
    files.rename(at(path), at(f"{path}.old"))
    files.rename(at(f"{path}.next"), at(path))
    files.delete(at(f"{path}.old"), True)


def cached_labels(state: DataFrame) -> DataFrame:
    return state.select("cache_key", F.explode("labels").alias("l")).select("cache_key", "l.*")


def cached_summary(state: DataFrame) -> DataFrame:
    return state.where("tldr is not null").select("cache_key", "tldr")


def missing_models(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Wanted models (model) that are not installed, exactly or with a tag."""
    name = F.col("have")
    return wanted.join(installed.select(F.col("model").alias("have")), (F.col("model") == name) | name.startswith(F.concat("model", F.lit(":"))), "left_anti")
