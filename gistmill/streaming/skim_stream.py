"""Skimming documents as they arrive: a file stream, a batch pipeline for each
micro-batch, and a table in which a document is written once per key: a key that an
earlier batch wrote is passed over, and of rows with one doc_id in a batch the one
with the largest text counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import skim, text_sentences
from gistmill.sources.state import cache_key


def start(spark: SparkSession, source: str, out: str, checkpoint: str, config: SkimConfig | None = None):
    """A query that skims Parquet documents (doc_id, text) under `source` into
    partitions of `out`, one for each micro-batch, so a replayed batch replaces itself."""
    config = config or SkimConfig()
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        df = df.groupBy("doc_id").agg(F.max("text").alias("text"))
        keyed = df.withColumn("cache_key", cache_key(F.coalesce("text", F.lit("")), config.provider, config.model_name, config.label_mode, []))
        try:
            written = spark.read.parquet(out).where(F.col("batch") != number).select("cache_key").distinct()
            keyed = keyed.join(written, "cache_key", "left_anti")
        except AnalysisException:  # nothing written yet
            pass
        run = skim(text_sentences(keyed.select("doc_id", "text")), config)
        rows = run.viewed.select("doc_id", "sent_id", "page_index", "text", "label", "confidence").join(keyed.select("doc_id", "cache_key"), "doc_id")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
