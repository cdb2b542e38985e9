"""Running headers and footers, and the reference zone, from document statistics.

Input lines: doc_id, page_index, line_no, start_char, end_char, baseline, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import vocab
from gistmill.functions.text import furniture_key, reference_score, trim


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def furniture(lines: DataFrame, *, share: float = vocab.FURNITURE_SHARE, least_pages: int = vocab.FURNITURE_PAGES) -> DataFrame:
    """doc_id, page_index, key, start_char, end_char of lines that repeat near one
    height on enough pages; documents of fewer than three pages have none."""
    first = Window.partitionBy("doc_id", "page_index", "key").orderBy("line_no")
    keyed = lines.withColumn("key", furniture_key(F.col("text"))).where(F.length("key") >= vocab.FURNITURE_KEY)
    keyed = keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1").withColumn("bucket", _half_up(F.col("baseline") / vocab.FURNITURE_BAND))
    paged = lines.groupBy("doc_id").agg(F.countDistinct("page_index").alias("paged")).where(F.col("paged") >= vocab.FURNITURE_PAGES)
    groups = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("pages"), (F.max("bucket") - F.min("bucket")).alias("spread"))
    least = F.greatest(F.lit(least_pages), F.ceil(F.col("paged") * F.lit(share)))
    good = groups.join(paged, "doc_id").where((F.col("pages") >= least) & (F.col("spread") <= 1)).select("doc_id", "key")
    return keyed.join(good, ["doc_id", "key"]).select("doc_id", "page_index", "key", "start_char", "end_char")


def reference_start(lines: DataFrame) -> DataFrame:
    """doc_id, reference_start_page: the start of the last run of pages dense with
    reference signals, -1 where there is none.  Pages after the run do not end it."""
    long = F.length(trim(F.col("text"))) > vocab.REFERENCE_LINE
    votes = long & (reference_score(F.col("text")) > 0)
    pages = lines.groupBy("doc_id", "page_index").agg(F.count_if(long).alias("lines"), F.count_if(votes).alias("hits"))
    dense = (F.col("hits") >= vocab.REFERENCE_HITS) & (F.col("hits") >= F.col("lines") * F.lit(vocab.REFERENCE_DENSITY))
    every = Window.partitionBy("doc_id")
    pages = pages.withColumn("dense", dense).withColumn("paged", F.count("*").over(every))
    pages = pages.withColumn("last", F.max(F.when(F.col("dense"), F.col("page_index"))).over(every))
    pages = pages.withColumn("gap", F.max(F.when(~F.col("dense") & (F.col("page_index") < F.col("last")), F.col("page_index"))).over(every))
    run = (F.col("paged") >= vocab.FURNITURE_PAGES) & F.col("dense") & (F.col("page_index") <= F.col("last")) & (F.col("page_index") > F.coalesce("gap", F.lit(-1)))
    return pages.groupBy("doc_id").agg(F.coalesce(F.min(F.when(run, F.col("page_index"))), F.lit(-1)).alias("reference_start_page"))


def doc_zones(lines: DataFrame, **how) -> DataFrame:
    """doc_id, furniture_line_count, reference_start_page."""
    counts = furniture(lines, **how).groupBy("doc_id").agg(F.countDistinct("key").alias("furniture_line_count"))
    out = reference_start(lines).join(counts, "doc_id", "left")
    return out.select("doc_id", F.coalesce("furniture_line_count", F.lit(0)).alias("furniture_line_count"), "reference_start_page")


def without_furniture(sents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sentences whose half-open range meets no furniture range of their page."""
    f = ranges.select(F.col("doc_id").alias("fd"), F.col("page_index").alias("fp"), F.col("start_char").alias("fs"), F.col("end_char").alias("fe"))
    meets = (F.col("doc_id") == F.col("fd")) & (F.col("page_index") == F.col("fp")) & (F.col("start_char") < F.col("fe")) & (F.col("end_char") > F.col("fs"))
    return sents.join(f, meets, "left_anti")
