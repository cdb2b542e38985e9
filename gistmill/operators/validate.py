"""Validation and repair of what a selector returns.

Replies are JSON text.  Entries are read with all fields as strings, so numbers and
numeric strings are one case; a reply is one row, its entries are exploded with
their place, and the rules are filters and windows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gistmill.functions import vocab

ENTRY = "struct<id:string,label:string,category:string,role:string,importance:string,confidence:string,score:string,weight:string>"


def strip_reasoning(c: Column) -> Column:
    """Without reasoning blocks; after a stray closing tag, what follows the last."""
    c = F.regexp_replace(c, r"(?is)<(think|thinking|reasoning)>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?is)^.*</think>", "")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _balanced(text: str):
    """Stretches from an opening bracket to its match, in one pass.  Strings count from
    the start; after an opening bracket without a match there is nothing more."""
    start, depth, quoted, escaped, opener, closer = -1, 0, False, False, "", ""
    for i, ch in enumerate(text):
        if quoted:
            quoted = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif start < 0:
            if ch in "{[":
                start, depth, opener, closer = i, 1, ch, "}" if ch == "{" else "]"
        elif ch == opener:
            depth += 1
        elif ch == closer:
            depth -= 1
            if not depth:
                yield text[start : i + 1]
                start = -1


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def loose_json_text(text: str | None) -> str | None:
    """The JSON of a reply: all of it, else the last balanced part that parses."""
    if text is None:
        return None
    try:
        json.loads(text, parse_constant=_refuse)
        return text.strip()
    except (ValueError, RecursionError):
        found = None
        for part in _balanced(text):
            try:
                json.loads(part, parse_constant=_refuse)
                found = part
            except (ValueError, RecursionError):
                continue
        return found


def loose_json(c: Column) -> Column:
    """loose_json_text as a column.  A reply that is strict JSON as it stands is told by
    the JVM; Python gets nulls for those."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(loose_json_text)

    body = F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    strict = body.rlike(r"\A[{\[]") & F.try_parse_json(body).isNotNull()
    return F.coalesce(F.when(strict, body), F.pandas_udf(run, StringType())(F.when(~F.coalesce(strict, F.lit(False)), c)))


def entries(replies: DataFrame, *names: str, bare: bool = False) -> DataFrame:
    """replies (keys, json) with `items`: the array under the first of `names` that is
    an array, or the bare array itself; null if there is none."""
    wrapped = F.from_json("json", ", ".join(f"{n} string" for n in names))
    array = lambda c: F.when(F.regexp_replace(c, r"(?s)^\s*(.).*$", "$1") == "[", F.from_json(c, f"array<{ENTRY}>"))
    options = [array(wrapped[n]) for n in names]
    if bare:
        options.append(array(F.col("json")))
    return replies.withColumn("items", F.coalesce(*options))


def number(c: Column) -> Column:
    """A finite number, from a number or a numeric string, else null."""
    n = F.when(F.trim(c) != "", c.try_cast("double"))
    return F.when(n.between(-1.7e308, 1.7e308), n)


def _numbered(replies: DataFrame, keys: list[str]) -> DataFrame:
    return replies.select(*keys, "sentence_count", "max_items", F.posexplode("items").alias("place", "e"))


def _first_of_id(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("place"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth")


def _strongest(rows: DataFrame, keys: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("importance"), "id"))
    within = F.coalesce(F.col("max_items"), F.lit(0)) == 0
    return rows.withColumn("nth", nth).where(within | (F.col("nth") <= F.greatest(F.lit(1), F.col("max_items")))).drop("nth")


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def selection(replies: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, label, importance of the valid entries.  replies: keys, items,
    sentence_count, max_items (null or 0: no limit); labels: key, name, with doc_id
    where each document has a set of its own (keys then hold doc_id)."""
    own = ["doc_id"] if "doc_id" in labels.columns else []
    rows = _numbered(replies, keys)
    rows = rows.withColumn("id", number(F.col("e.id")).cast("long")).where(F.col("id").between(0, F.col("sentence_count") - 1))
    names = labels.select(*own, F.lower("key").alias("said"), "key", F.lit(0).alias("by")).unionByName(labels.select(*own, F.lower("name").alias("said"), "key", F.lit(1).alias("by")))
    names = names.groupBy(*own, "said").agg(F.max_by("key", "by").alias("label"))
    rows = rows.withColumn("said", F.lower(F.trim(F.coalesce("e.label", "e.category", F.lit("")))))
    rows = rows.join(names if own else F.broadcast(names), [*own, "said"])  # one label set has at most 16 names
    score = F.coalesce(*(number(F.col(f"e.{n}")) for n in ("importance", "confidence", "score", "weight")), F.lit(0.7))
    rows = _first_of_id(rows.withColumn("importance", _unit(score)), keys)
    return _strongest(rows, keys).select(*keys, "id", "label", "importance")


def adaptive_selection(replies: DataFrame, keys: list[str]) -> DataFrame:
    """As selection, with any label that is not blank."""
    rows = _numbered(replies, keys)
    rows = rows.withColumn("id", number(F.col("e.id")).cast("long")).where(F.col("id").between(0, F.col("sentence_count") - 1))
    rows = rows.withColumn("label", F.trim(F.coalesce("e.label", F.lit("")))).where("label <> ''")
    score = F.coalesce(number(F.col("e.importance")), number(F.col("e.confidence")), F.lit(0.7))
    rows = _first_of_id(rows.withColumn("importance", _unit(score)), keys)
    return _strongest(rows, keys).select(*keys, "id", "label", "importance")


def accepted(replies: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accepted: whether a reply stands.  An empty result stands only when empty
    is allowed and the array was empty."""
    n = valid.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = replies.join(n, keys, "left")
    empty = F.col("allow_empty") & (F.size("items") == 0)
    return out.select(*keys, F.coalesce((F.coalesce("__n", F.lit(0)) > 0) | empty, F.lit(False)).alias("accepted"))


def reduced(replies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, role, importance of the core that a reduce reply names; nothing
    where it lacks a needed role.  A null id counts as 0, a null score as 0."""
    rows = _numbered(replies, keys)
    loose = lambda c: F.when(c.isNull() | (F.trim(c) == ""), F.lit(0.0)).otherwise(number(c))
    rows = rows.where("e is not null").withColumn("id", loose(F.col("e.id")).cast("long")).where(F.col("id").between(0, F.col("sentence_count") - 1))
    rows = rows.withColumn("role", F.lower(F.trim(F.coalesce("e.role", F.lit(""))))).where(F.col("role").isin(vocab.NARRATIVE_ROLES))
    rows = _first_of_id(rows.withColumn("importance", _unit(F.coalesce(loose(F.col("e.importance")), F.lit(0.9)))), keys)
    every = Window.partitionBy(*keys)
    has = lambda role: F.bool_or(F.col("role") == role).over(every)
    best = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("importance"))).over(every), F.lit(-1.0))
    rows = rows.withColumn("covered", has("problem") & has("central_claim") & has("significance") & (has("development") | has("evidence"))).where("covered")
    bridge = F.when(best("development") >= best("evidence"), "development").otherwise("evidence")
    top = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("importance"), "id")) == 1
    rows = rows.withColumn("bridge", bridge).withColumn("top", top)
    rows = rows.withColumn("needed", F.col("top") & (F.col("role").isin("problem", "central_claim", "significance") | (F.col("role") == F.col("bridge"))))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("needed"), F.desc("importance"), "id"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= F.greatest(F.lit(4), F.col("max_items"))).select(*keys, "id", "role", "importance")


def reduce_target(span: Column) -> Column:
    return F.least(F.lit(24), F.greatest(F.lit(4), F.floor(span * F.lit(1.2) + 0.5))).cast("int")


def mark_core(sents: DataFrame, core: DataFrame) -> DataFrame:
    """sents with core set, and confidence raised, for what the reduce kept.
    core: doc_id, sent_id, importance."""
    out = sents.drop("core").join(core.select("doc_id", "sent_id", F.col("importance").alias("__i")), ["doc_id", "sent_id"], "left")
    return out.withColumn("core", F.col("__i").isNotNull()).withColumn("confidence", F.greatest("confidence", F.coalesce("__i", F.lit(0.0)))).drop("__i")


def summary_text(c: Column) -> Column:
    """A summary with single spaces, or null when shorter than the least."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", "")
    return F.when(F.length(c) >= vocab.SUMMARY_MIN_CHARS, c)


def token_usage(replies: DataFrame) -> DataFrame:
    clean = lambda c: F.sum(F.when(F.col(c).cast("double").between(-1.7e308, 1.7e308), F.col(c)).otherwise(0)).cast("long")
    return replies.groupBy("doc_id").agg(clean("usage_in").alias("tokens_in"), clean("usage_out").alias("tokens_out"))
