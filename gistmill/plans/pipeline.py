"""The skimming run as one composition of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions.text import reference_score
from gistmill.operators import budget, geometry, labels, prompts, sections, segment, select, spans, validate, view, zoning
from gistmill.plans.config import SkimConfig
from gistmill.sources.state import work_folder


@dataclass
class Run:
    """What a run gives."""

    sentences: DataFrame
    requests: DataFrame
    failed: DataFrame
    classified: DataFrame
    viewed: DataFrame
    state: DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_sentences(docs: DataFrame) -> DataFrame:
    """Candidates of plain documents: a page a line, body everywhere, no filter."""
    cands = segment.numbered(segment.candidates(segment.lines(docs)))
    return cands.select("doc_id", "sent_id", "page_index", "start_char", "end_char", "text", F.lit("body").alias("section"))


def glyph_sentences(pages: DataFrame) -> DataFrame:
    """Candidates of structured pages: zoned, cleared of furniture, with section roles,
    filtered."""
    lines = geometry.lines_of_pages(pages)
    cands = zoning.without_furniture(spans.candidates(pages), zoning.furniture(lines))
    cands = segment.numbered(cands).join(sections.fill_sections(pages.select("doc_id", "page_index", "text")).select("doc_id", "page_index", "section"), ["doc_id", "page_index"])
    cands = sections.mark_references(sections.mark_front_matter(cands), zoning.reference_start(lines), reference_score(F.col("text")))
    return sections.keep_candidates(cands)


def skim(sents: DataFrame, config: SkimConfig, label_set: DataFrame | None = None, selector=None, reduce_replies: DataFrame | None = None) -> Run:
    """Chunk, ask, validate, reduce and view the candidates of a corpus.  Chunks and
    replies are tables of the run in the shared folder, so they are worked out once.  A
    chunk whose estimate is over 1.2 times the budget is not asked but fails."""
    spark = sents.sparkSession
    label_set = labels.default_labels(spark) if label_set is None else label_set
    chunked = written(budget.chunks(sents, config.selection_budget), "chunks")
    requests = prompts.with_contract(prompts.selection_requests(chunked), label_set)
    over = budget.chunk_guard(chunked, config.selection_budget).select("doc_id", "chunk_id", F.lit("over the budget").alias("error"))
    asked = requests.join(over, ["doc_id", "chunk_id"], "left_anti")
    selector = select.HeuristicSelector(chunked) if selector is None else selector
    select.require_consent(selector, config.consent)
    replies = written(selector.select(asked), "replies")
    picked, failed = select.chosen(replies, asked, label_set)
    failed = failed.unionByName(over)
    picked = picked.select("doc_id", "chunk_id", F.col("id").alias("local_id"), "label", F.col("importance").alias("confidence"))
    classified = chunked.join(picked, ["doc_id", "chunk_id", "local_id"]).withColumn("core", F.lit(False))
    if reduce_replies is not None:
        classified = reduce_core(classified, reduce_replies)
    viewed = view.view(classified, config.view == "core")
    usage = validate.token_usage(replies)
    state = chunked.groupBy("doc_id").agg(F.count("*").cast("int").alias("classified_count"), (F.max("page_index") + 1).alias("page_span"))
    state = state.join(failed.select("doc_id").distinct().withColumn("bad", F.lit(True)), "doc_id", "left").join(usage, "doc_id", "left")
    state = state.select("doc_id", F.col("bad").isNull().alias("complete"), "classified_count", "page_span", "tokens_in", "tokens_out")
    return Run(sents, requests, failed, classified, viewed, state)


def unit_sizes(sents: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, unit_id, sentence_count, max_items of the units of long works."""
    plan = budget.band_plan(sents).select("doc_id", "target")
    counts = units.groupBy("doc_id").agg(F.countDistinct("unit_id").alias("units")).join(plan, "doc_id")
    most = counts.select("doc_id", budget.per_unit(F.col("target"), F.col("units")).alias("max_items"))
    return units.groupBy("doc_id", "unit_id").agg(F.count("*").alias("sentence_count")).join(most, "doc_id")


def standing(replies: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, failed): the entries of the first valid reply to each unit, and the
    units without one, which are empty and do not stop the run."""
    keys = ["doc_id", "unit_id", "attempt"]
    read = replies.where(F.col("attempt") < select.ATTEMPTS).withColumn("json", validate.loose_json(validate.strip_reasoning(F.col("raw"))))
    read = validate.entries(read.join(sizes, ["doc_id", "unit_id"]).withColumn("allow_empty", F.lit(True)), "selected")
    valid = validate.adaptive_selection(read, keys)
    first = validate.accepted(read, valid, keys).where("accepted").groupBy("doc_id", "unit_id").agg(F.min("attempt").alias("attempt"))
    failed = sizes.join(first, ["doc_id", "unit_id"], "left_anti").select("doc_id", F.col("unit_id").alias("chunk_id"), F.lit("no valid reply").alias("error"))
    return valid.join(first, keys).drop("attempt"), failed


def evolved(sents: DataFrame, config: SkimConfig, units: DataFrame, sizes: DataFrame, named: DataFrame, failed: DataFrame, usage: DataFrame, done: DataFrame | None = None) -> Run:
    """The run of long works from named selections (doc_id, chunk_id, id, key, name,
    importance) and token usage; done (doc_id, unit_id) holds the units read so far, all
    if not given."""
    asked = prompts.adaptive_requests(units, labels.known_before(named, units), F.lit(None).cast("int")).drop("max_items").join(sizes.select("doc_id", "unit_id", "max_items"), ["doc_id", "unit_id"])
    picked = named.select("doc_id", F.col("chunk_id").alias("unit_id"), F.col("id").alias("local_id"), F.col("key").alias("label"), F.col("name").alias("label_name"), F.col("importance").alias("confidence"))
    classified = units.join(picked, ["doc_id", "unit_id", "local_id"]).withColumn("core", F.lit(False)).withColumnRenamed("unit_id", "chunk_id")
    state = units.groupBy("doc_id").agg(F.count("*").cast("int").alias("classified_count"), (F.max("page_index") + 1).alias("page_span"))
    if done is None:
        state = state.join(usage, "doc_id", "left").withColumn("complete", F.lit(True))
    else:
        asked = asked.join(done, ["doc_id", "unit_id"], "left_semi")
        read = units.join(done, ["doc_id", "unit_id"], "left_semi").groupBy("doc_id").agg(F.count("*").cast("int").alias("read"))
        state = state.join(read, "doc_id", "left").withColumn("complete", F.coalesce(F.col("read") == F.col("classified_count"), F.lit(False)))
        state = state.withColumn("classified_count", F.coalesce("read", F.lit(0))).drop("read").join(usage, "doc_id", "left")
    return Run(sents, asked.withColumnRenamed("unit_id", "chunk_id"), failed, classified, view.view(classified, config.view == "core"), state)


def skim_evolving(sents: DataFrame, config: SkimConfig, replies: DataFrame) -> Run:
    """The run of long works, whose labels grow as they are read: bands, or chunks of
    bands, are asked in order, labels are reconciled over each document's units.
    replies: doc_id, unit_id, attempt, raw, usage_in, usage_out, all there already;
    plans.rounds asks a live selector."""
    units = budget.banded_chunks(sents, config.selection_budget)
    sizes = unit_sizes(sents, units)
    valid, failed = standing(replies, sizes)
    named = labels.reconcile(valid.withColumnRenamed("unit_id", "chunk_id"))
    return evolved(sents, config, units, sizes, named, failed, validate.token_usage(replies))


def annotations(run: Run, config: SkimConfig, label_set: DataFrame) -> DataFrame:
    """Annotation rows of what a run shows, less hidden labels, with the label where the
    configuration wants it."""
    hidden = F.array_contains(labels.hidden_labels(F.lit(config.hidden_labels)), F.col("label"))
    shown = view.highlights(run.viewed.where(~hidden), label_set, [])
    return view.annotation_rows(shown, destination=config.annotation_destination, prefix=config.annotation_prefix)


def summarize(pages: DataFrame, cached: DataFrame, replies: DataFrame, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summaries, requests): doc_id, tldr of the first usable of two replies for the
    documents that have none cached (all, if forced), with the cached ones.
    cached: doc_id, tldr; replies: doc_id, attempt, raw ({"summary": ...})."""
    leading = segment.leading_text(pages)
    todo = leading if force else leading.join(cached.select("doc_id"), "doc_id", "left_anti")
    requests = prompts.summary_requests(todo)
    said = F.from_json(validate.loose_json(validate.strip_reasoning(F.col("raw"))), "summary string")["summary"]
    usable = replies.where(F.col("attempt") < select.ATTEMPTS).withColumn("tldr", validate.summary_text(said)).where("tldr is not null")
    new = usable.join(requests.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("tldr", "attempt").alias("tldr"))
    kept = cached.select("doc_id", "tldr").join(new.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(new), requests


def reduce_core(classified: DataFrame, replies: DataFrame) -> DataFrame:
    """classified with the core that reduce replies (doc_id, raw) name; documents with
    fewer than six candidates, or whose reply fails, stay as they are."""
    from pyspark.sql import Window

    cands = classified.withColumn("cand_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")) - 1)
    asked = prompts.reduce_requests(cands, validate.reduce_target(F.col("span")))
    read = replies.withColumn("json", validate.loose_json(validate.strip_reasoning(F.col("raw")))).join(asked.select("doc_id", "sentence_count", "max_items"), "doc_id")
    core = validate.reduced(validate.entries(read, "core", "selected"), ["doc_id"])
    core = core.join(cands.select("doc_id", F.col("cand_id").alias("id"), "sent_id"), ["doc_id", "id"])
    return validate.mark_core(classified, core)
