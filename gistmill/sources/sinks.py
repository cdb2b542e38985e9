"""Sinks: annotations, e-book annotations and summary notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions.text import escape_note, find_quote, match_key
from gistmill.operators.geometry import positions
from gistmill.operators.view import annotation_rows, not_saved


def save_annotations(shown: DataFrame, pages: DataFrame, saved: DataFrame, path: str, **how) -> DataFrame:
    """Append annotation rows of highlights that are not saved yet; rows without a page
    or a rectangle are skipped.  Returns what was written."""
    spark = shown.sparkSession
    rows = not_saved(positions(annotation_rows(shown, **how), pages), saved)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(shown.select("doc_id").distinct(), "doc_id", "left_semi")


def locate_quotes(shown: DataFrame, sections: DataFrame) -> DataFrame:
    """shown with `at`: the place of its text in the section (doc_id, page_index, text),
    -1 where it is not found."""
    hay = sections.select("doc_id", "page_index", match_key("text").alias("__hay"))
    out = shown.join(hay, ["doc_id", "page_index"], "left").withColumn("__q", match_key("text"))
    return out.withColumn("at", F.coalesce(find_quote(F.col("__hay"), F.col("__q")), F.lit(-1))).drop("__hay", "__q")


def located_counts(located: DataFrame) -> DataFrame:
    return located.groupBy("doc_id").agg(F.count_if(F.col("at") >= 0).alias("saved"), F.count_if(F.col("at") < 0).alias("skipped"))


def summary_notes(summaries: DataFrame) -> DataFrame:
    """doc_id, note: a titled note; the summary is escaped, the title is not."""
    return summaries.select("doc_id", F.concat(F.lit("<h1>"), F.coalesce("title", F.lit("Summary")), F.lit("</h1><p>"), escape_note(F.col("tldr")), F.lit("</p>")).alias("note"))
