"""The selector boundary: request rows in, reply rows out, and two offline selectors.

Requests: doc_id, chunk_id, sentence_count, max_items, user, and for the heuristic
the sentences themselves.  Replies: doc_id, chunk_id, attempt, raw, usage_in, usage_out.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.validate import accepted, entries, loose_json, selection, strip_reasoning

ATTEMPTS = 2
CUES = {
    "goal": r"(?i)\b(aim|goal|purpose|whether|question|objectif|ziel|objetivo)\b",
    "method": r"(?i)\b(method|using|used|measured|data|méthode|methode|método)\b",
    "result": r"(?i)\b(result|found|show|increase|decrease|résultat|ergebnis|resultado)\b",
    "novelty": r"(?i)\b(new|novel|first|unlike|nouveau|neu|nuevo)\b",
}


class Selector(Protocol):
    def select(self, requests: DataFrame) -> DataFrame:
        """Replies to requests, at most ATTEMPTS for each."""


def require_consent(selector: Selector, consent: bool) -> None:
    """A selector that says it sends texts elsewhere (sends_text) needs consent."""
    if getattr(selector, "sends_text", False) and not consent:
        raise PermissionError("this selector sends document text to a service; set consent to allow that")


class ReplaySelector:
    """Answers from a table doc_id, chunk_id, attempt, raw, usage_in, usage_out."""

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def select(self, requests: DataFrame) -> DataFrame:
        return self.replies.join(requests.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")


def cue_label(text: Column) -> Column:
    """The first label with a cue word; sentences without one go round by length."""
    out = F.element_at(F.array(*map(F.lit, CUES)), (F.length(text) % len(CUES) + 1).cast("int"))
    for label, pattern in reversed(CUES.items()):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def cue_score(text: Column) -> Column:
    """A plain score in hundredths from the length: ours, for offline runs only."""
    return (40 + F.length(text) % 60) / F.lit(100.0)


class HeuristicSelector:
    """A deterministic stand-in for a model, needing `sentences` (doc_id, chunk_id,
    local_id, text): the best scores of each chunk, as JSON."""

    def __init__(self, sentences: DataFrame):
        self.sentences = sentences

    def select(self, requests: DataFrame) -> DataFrame:
        s = self.sentences.withColumn("importance", cue_score(F.col("text"))).withColumn("label", cue_label(F.col("text")))
        s = s.join(requests.select("doc_id", "chunk_id", "max_items"), ["doc_id", "chunk_id"])
        nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc("importance"), "local_id"))
        top = s.withColumn("nth", nth).where(F.col("nth") <= F.col("max_items"))
        items = F.array_sort(F.collect_list(F.struct(F.col("local_id").alias("id"), "label", "importance")))
        raw = top.groupBy("doc_id", "chunk_id").agg(F.to_json(F.struct(items.alias("selected"))).alias("raw"))
        return raw.select("doc_id", "chunk_id", F.lit(0).alias("attempt"), "raw", (F.length("raw") / 4).cast("long").alias("usage_in"), (F.length("raw") / 4).cast("long").alias("usage_out"))


def chosen(replies: DataFrame, requests: DataFrame, labels: DataFrame, *, allow_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selected, failed): the valid entries of the first attempt of each request that
    stands, and the requests without one."""
    keys = ["doc_id", "chunk_id", "attempt"]
    read = replies.where(F.col("attempt") < ATTEMPTS).withColumn("json", loose_json(strip_reasoning(F.col("raw"))))
    read = read.join(requests.select("doc_id", "chunk_id", "sentence_count", "max_items"), ["doc_id", "chunk_id"]).withColumn("allow_empty", F.lit(allow_empty))
    read = entries(read, "selected", "sentences", bare=True)
    valid = selection(read, labels, keys)
    good = accepted(read, valid, keys).where("accepted").groupBy("doc_id", "chunk_id").agg(F.min("attempt").alias("attempt"))
    failed = requests.join(good, ["doc_id", "chunk_id"], "left_anti").select("doc_id", "chunk_id", F.lit("no valid reply").alias("error"))
    return valid.join(good, keys).drop("attempt"), failed
