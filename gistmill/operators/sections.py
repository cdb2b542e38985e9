"""Section roles of pages and sentences, and the filter of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import vocab
from gistmill.functions.text import BORDER, WS


def page_section(text: Column) -> Column:
    """The role of a heading at the very start of a page, or null: the first role in
    list order whose first match begins within 13 characters of the first 160."""
    lead = F.regexp_replace(F.substring(text, 1, 160), f"^{WS}+", "")
    early = lambda pattern: F.regexp_instr(lead, F.lit(pattern)).between(1, 13)
    out = F.lit(None).cast("string")
    for role, words in reversed(vocab.RTL_SECTION_WORDS):
        out = F.when(early(f"(?:{words})"), role).otherwise(out)
    out = F.when(lead.rlike("[\u0600-\u06ff]"), out)
    for role, words in reversed(vocab.SECTION_WORDS):
        out = F.when(early(f"(?iu){BORDER}(?:{words}){BORDER}"), role).otherwise(out)
    return out


def fill_sections(pages: DataFrame) -> DataFrame:
    """pages with section: the last heading's role so far, else body."""
    upto = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.coalesce(F.last(page_section(F.col("text")), ignorenulls=True).over(upto), F.lit("body")))


def mark_front_matter(sents: DataFrame, limit: int = vocab.FRONT_MATTER_CHARS) -> DataFrame:
    """The short sentences that open page 0 become front matter, to the first long one."""
    upto = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, 0)
    body_begun = F.max((F.length("text") >= limit) | (F.col("page_index") != 0)).over(upto)
    return sents.withColumn("section", F.when(~body_begun, "front matter").otherwise(F.col("section")))


def mark_references(sents: DataFrame, zones: DataFrame, score: Column) -> DataFrame:
    """Sentences after the reference zone's start page, or on it with a vote, become
    references.  zones: doc_id, reference_start_page (-1: none)."""
    start = F.coalesce("reference_start_page", F.lit(-1))
    inside = (start >= 0) & ((F.col("page_index") > start) | ((F.col("page_index") == start) & (score >= 1)))
    out = sents.join(zones.select("doc_id", "reference_start_page"), "doc_id", "left")
    return out.withColumn("section", F.when(inside, "references").otherwise(F.col("section"))).drop("reference_start_page")


def keep_candidates(sents: DataFrame) -> DataFrame:
    """Without references and front matter; a document that would lose all keeps all."""
    good = ~F.col("section").isin("references", "front matter")
    left = F.count_if(good).over(Window.partitionBy("doc_id"))
    return sents.withColumn("__left", left).where(good | (F.col("__left") == 0)).drop("__left")
