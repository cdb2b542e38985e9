"""Sentence candidates of text pages, with their places in the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import sentences, vocab
from gistmill.functions.text import BLANKS, trim

_MARK = "\x01"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, text: a page for each line of a document."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page_index", "text"))


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _placed(pieces: Column, base: Column | int = 0) -> Column:
    """(start_char, text) of pieces that make up a text from `base` on, trimmed."""
    head = lambda p: F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))
    place = lambda raw, at: F.struct((at + head(raw) + base).cast("int").alias("start_char"), F.btrim(raw, F.lit(BLANKS)).alias("text"))
    return _once(pieces, lambda p: F.zip_with(p, sentences.starts(p), place))


def is_candidate(c: Column) -> Column:
    return (F.length(c) >= vocab.MIN_CHARS) & c.rlike("[A-Za-z]{3}")


def split_long(c: Column) -> Column:
    """A piece of over MAX_CHARS cut at clause marks once SPLIT_CHARS are held; the
    rest stays if MIN_CHARS long.  Nothing is dropped before that rest."""
    parts = F.split(F.regexp_replace(c, rf"([.;:!?»)]\s+)", f"$1{_MARK}"), _MARK)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc, part):
        held = F.concat(acc["held"], part)
        full = F.length(held) >= vocab.SPLIT_CHARS
        return F.struct(F.when(full, F.array_append(acc["out"], held)).otherwise(acc["out"]).alias("out"), F.when(full, F.lit("")).otherwise(held).alias("held"))

    end = lambda acc: F.when(F.length(acc["held"]) >= vocab.MIN_CHARS, F.array_append(acc["out"], acc["held"])).otherwise(acc["out"])
    return F.when(F.length(c) <= vocab.MAX_CHARS, F.array(c)).otherwise(F.aggregate(parts, state, step, end))


def candidates(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, nth (within the page), start_char, end_char (code points of
    the page), text of every candidate sentence."""
    fits = lambda s: is_candidate(s["text"])
    parts = lambda s: F.when(F.length(s["text"]) <= vocab.MAX_CHARS, F.array(s)).otherwise(F.filter(_placed(split_long(s["text"]), s["start_char"]), fits))
    cut = F.flatten(F.transform(F.filter(_placed(sentences.split(F.col("text"))), fits), parts))
    found = pages.select("doc_id", "page_index", F.posexplode(cut).alias("nth", "s"))
    return found.select("doc_id", "page_index", "nth", "s.start_char", (F.col("s.start_char") + F.length("s.text")).alias("end_char"), "s.text")


def numbered(cands: DataFrame) -> DataFrame:
    """With sent_id, dense within the document in reading order."""
    order = Window.partitionBy("doc_id").orderBy("page_index", "nth")
    return cands.withColumn("sent_id", F.row_number().over(order) - 1)


def identity_page(index: Column, text: Column) -> list[Column]:
    """A page of plain text: its map is the identity and it has no glyphs."""
    n = F.length(text)
    return [index.alias("page_index"), text.alias("text"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("char_map")]


def pages_from_sentences(sents: DataFrame) -> DataFrame:
    """Coarse page texts rebuilt from sentences in order."""
    ordered = F.array_sort(F.collect_list(F.struct("sent_id", "text")))
    return sents.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))


def leading_text(pages: DataFrame, limit: int = vocab.LEADING_CHARS) -> DataFrame:
    """doc_id, text: pages with a line break after each, cut at `limit`, trimmed.
    Only pages that start before the limit are gathered."""
    before = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    held = pages.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("at") < limit)
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    joined = F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit("\n"))
    return held.groupBy("doc_id").agg(trim(F.substring(joined, 1, limit)).alias("text"))


def discovery_sample(whole: Column) -> Column:
    """Head, middle and tail of a text for finding labels."""
    n, c = F.length(whole), vocab.DISCOVERY_CHARS
    tail = F.substring(whole, F.greatest(n - c // 5, F.lit(0)) + 1, F.lit(c // 5))
    return F.concat_ws("\n[...]\n", F.substring(whole, 1, c * 3 // 5), F.substring(whole, F.floor(n / 2).cast("int") + 1, F.lit(c // 5)), tail)
