"""Requests to a selector: wording (our own), sentence lists and reply schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import vocab

SYSTEM = "Pick sentences that let a reader grasp a document quickly. Give each pick one of these labels:\n"
SYSTEM_RULES = "\nLeave out boilerplate, captions and references. Prefer a varied set without repeats."


def system_text(labels: DataFrame) -> DataFrame:
    """One row: the system text of a label set, with at most two examples a label."""
    shown = F.concat(F.lit("- "), "key", F.lit(": "), "description", F.coalesce(F.concat(F.lit("; not: "), "anti_description"), F.lit("")), F.when(F.size("examples") > 0, F.concat(F.lit("; e.g. "), F.array_join(F.slice("examples", 1, 2), " / "))).otherwise(""))
    rows = labels.select("ord", shown.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return rows.agg(F.concat(F.lit(SYSTEM), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit(SYSTEM_RULES)).alias("system"))


def sentence_list(id_column: str) -> Column:
    """id | page n | section s | text, a line for each sentence, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(id_column).alias("id"), (F.col("page_index") + 1).alias("page"), "section", "text")))
    line = lambda s: F.concat(s["id"].cast("string"), F.lit(" | page "), s["page"].cast("string"), F.lit(" | section "), s["section"], F.lit(" | "), s["text"])
    return F.array_join(F.transform(ordered, line), "\n")


def selection_requests(chunked: DataFrame) -> DataFrame:
    """doc_id, chunk_id, sentence_count, max_items, user for each chunk."""
    grouped = chunked.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("sentence_count"), (3 * F.countDistinct("page_index")).cast("int").alias("max_items"), sentence_list("local_id").alias("body"))
    head = F.concat(F.lit("Pick at most "), F.col("max_items").cast("string"), F.lit(" sentences; fewer is fine.\n"))
    return grouped.withColumn("user", F.concat(head, "body")).drop("body")


def with_contract(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """requests with `system` (what to do, the labels) and `schema` (JSON of the reply
    asked for: the labels' keys, at most max_items entries)."""
    slot = 987_654_321  # stands for max_items, which is the row's
    keys = [r.key for r in labels.select("key", "ord").orderBy("ord").collect()]  # a label set has at most eight
    head, tail = selection_schema(keys, slot).split(str(slot))
    schema = F.concat(F.lit(head), F.col("max_items").cast("string"), F.lit(tail))
    return requests.crossJoin(F.broadcast(system_text(labels))).withColumn("schema", schema)  # one row


def adaptive_requests(units: DataFrame, known: DataFrame, per_unit: Column) -> DataFrame:
    """As selection_requests for units whose labels may grow: the labels known so far
    come first.  known: doc_id, unit_id, known (text); a unit without a row knows none."""
    grouped = units.groupBy("doc_id", "unit_id").agg(F.count("*").alias("sentence_count"), sentence_list("local_id").alias("body")).join(known, ["doc_id", "unit_id"], "left")
    head = F.concat(F.lit("Use these labels where they fit, else name a new one: "), F.coalesce("known", F.lit("none yet")), F.lit("\n"))
    return grouped.withColumn("max_items", per_unit).withColumn("user", F.concat(head, "body")).drop("body", "known")


def reduce_requests(candidates: DataFrame, target: Column) -> DataFrame:
    """doc_id, sentence_count, max_items, user over all candidates of a document, where
    there are six or more.  candidates have cand_id, dense by document."""
    grouped = candidates.groupBy("doc_id").agg(F.count("*").alias("sentence_count"), (F.max("page_index") + 1).alias("span"), sentence_list("cand_id").alias("body")).where("sentence_count >= 6")
    head = F.concat(F.lit("Keep the smallest set that tells the whole story, at most "), F.col("max_items").cast("string"), F.lit(", each with one role of " + ", ".join(vocab.NARRATIVE_ROLES) + ".\n"))
    return grouped.withColumn("max_items", target).withColumn("user", F.concat(head, "body")).drop("body", "span")


def summary_requests(leading: DataFrame) -> DataFrame:
    return leading.where("text <> ''").select("doc_id", F.concat(F.lit("Say in two to four plain sentences what this text is about, from the text only.\n\n"), "text").alias("user"))


def _array(name: str, item: dict, most: int | None = None) -> str:
    body = {"type": "array", "items": {"type": "object", "properties": item, "required": list(item), "additionalProperties": False}}
    if most:
        body["maxItems"] = most
    return json.dumps({"type": "object", "properties": {name: body}, "required": [name], "additionalProperties": False})


def selection_schema(keys: list[str], most: int) -> str:
    return _array("selected", {"id": {"type": "integer"}, "label": {"type": "string", "enum": keys}, "importance": {"type": "number"}}, most)


def adaptive_schema(most: int) -> str:
    return _array("selected", {"id": {"type": "integer"}, "label": {"type": "string"}, "importance": {"type": "number"}}, most)


def reduce_schema() -> str:
    return _array("core", {"id": {"type": "integer"}, "role": {"type": "string", "enum": vocab.NARRATIVE_ROLES}, "importance": {"type": "number"}}, 24)


def discovery_schema() -> str:
    return _array("labels", {"key": {"type": "string"}, "name": {"type": "string"}, "description": {"type": "string"}})


SUMMARY_SCHEMA = json.dumps({"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"], "additionalProperties": False})
