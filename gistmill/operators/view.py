"""Views, aggregates and annotation rows of classified sentences.

sents: doc_id, sent_id, page_index, start_char, end_char, text, label, confidence, core.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import vocab
from gistmill.functions.text import annotation_key, clean_text, color_hex, label_fields, sort_index


def view(sents: DataFrame, core_only: bool = True) -> DataFrame:
    """Labelled sentences of enough confidence; the core view shows the core where a
    document has any."""
    good = sents.where((F.col("label") != "none") & (F.col("confidence") >= F.lit(vocab.VIEW_CONFIDENCE)))
    if not core_only:
        return good
    some = F.bool_or("core").over(Window.partitionBy("doc_id"))
    return good.withColumn("__some", some).where(~F.col("__some") | F.col("core")).drop("__some")


def counts_by_label(viewed: DataFrame) -> DataFrame:
    return viewed.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def highlights(viewed: DataFrame, labels: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """What is shown: the view less hidden labels, with label name and colour."""
    shown = labels.select(F.col("key").alias("label"), F.col("name").alias("label_name"), "color")
    out = viewed.where(~F.col("label").isin(list(hidden))) if hidden else viewed
    out = out.join(F.broadcast(shown), "label")  # a label set has at most eight rows
    return out.select("doc_id", "page_index", "start_char", "end_char", "color", "label_name", "text")


def run_summary(sents: DataFrame, viewed: DataFrame, state: DataFrame) -> DataFrame:
    """One row a document: kept, pages covered, core, considered, span, tokens, state.
    state: doc_id, complete, classified_count, page_span, tokens_in, tokens_out."""
    kept = viewed.groupBy("doc_id").agg(F.count("*").alias("selections"), F.countDistinct("page_index").alias("pages_covered"))
    core = sents.groupBy("doc_id").agg(F.count_if("core").alias("core_count"))
    out = state.join(kept, "doc_id", "left").join(core, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    tokens = (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens")
    return out.select("doc_id", cache_state(F.col("complete")).alias("state"), zero("selections"), zero("pages_covered"), zero("core_count"), F.col("classified_count").alias("considered"), "page_span", tokens)


def cache_state(complete: Column) -> Column:
    return F.when(complete.isNull(), "none").when(complete, "complete").otherwise("partial")


def summary_line(s: Column) -> Column:
    """The status line of a run summary (columns of run_summary, tokens apart): what is
    shown once complete, what was processed while partial, nothing before."""
    used = F.when((s["tokens_in"] > 0) | (s["tokens_out"] > 0), F.format_string(" · %,d in / %,d out tokens", s["tokens_in"], s["tokens_out"])).otherwise("")
    pages = F.when(s["page_span"] > 0, F.format_string(" across %d/%d pages", s["pages_covered"], s["page_span"])).otherwise("")
    core = F.when(s["core_count"] > 0, F.format_string(" · %d core", s["core_count"])).otherwise("")
    done = F.concat(F.format_string("✓ Complete — %d highlights", s["selections"]), pages, core, used)
    part = F.concat(F.format_string("◐ Partial — %d sentences processed", s["considered"]), used, F.lit(". Generate resumes."))
    return F.when(s["state"] == "complete", done).when(s["state"] == "partial", part)


def of_complete_runs(shown: DataFrame, state: DataFrame) -> DataFrame:
    """Highlights of documents whose run is complete (state: doc_id, complete)."""
    return shown.join(state.where(F.coalesce("complete", F.lit(True))).select("doc_id").distinct(), "doc_id", "left_semi")


def in_order(shown: DataFrame) -> DataFrame:
    """Highlights by document in reading order."""
    return shown.orderBy("doc_id", "page_index", "start_char")


def annotation_rows(shown: DataFrame, *, destination: str = "comment", prefix: bool = False) -> DataFrame:
    """Annotation rows of highlights; keys depend on the place only, so a second save
    writes the same keys."""
    comment, tags = label_fields(F.col("label_name"), destination, prefix)
    return shown.select(
        "doc_id",
        annotation_key(F.col("doc_id"), F.col("page_index"), F.col("start_char"), F.col("end_char")).alias("key"),
        F.lit("highlight").alias("type"),
        clean_text(F.col("text")).alias("text"),
        comment.alias("comment"),
        tags.alias("tags"),
        color_hex(F.col("color")).alias("color"),
        (F.col("page_index") + 1).cast("string").alias("page_label"),
        sort_index(F.col("page_index"), F.col("start_char")).alias("sort_index"),
        "page_index",
        "start_char",
        "end_char",
    )


def not_saved(annotations: DataFrame, saved: DataFrame) -> DataFrame:
    """Annotations whose key is not saved yet (saved: doc_id, key)."""
    return annotations.join(saved.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def grouped(shown: DataFrame, *keys: str) -> DataFrame:
    """Highlights gathered by page or label, in order."""
    return shown.groupBy("doc_id", *keys).agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "color", "text"))).alias("specs"))
