"""A run that keeps its state, and takes up where an earlier one stopped.

A text is asked about once for each configuration: documents with the same cache key
share one row of state.  Within a document chunks count in order.  A chunk without a
valid reply ends the document there; what came before it is kept, and the next run
asks from that chunk on, under the chunk budget the document began with.  Tokens add
up over runs.  A document without candidates is complete and empty; null texts count
as empty.  doc_id must be unique, sentences of unknown documents are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import vocab
from gistmill.operators import budget, labels, prompts, segment, select, validate, view
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import reduce_core, skim_evolving, summarize
from gistmill.sources import state

REDUCED_FROM = 6
_FIELDS = ["sent_id", "page_index", "start_char", "end_char", "text", "section", "label", "confidence", "core"]
_LABELS = "array<struct<key:string,name:string,color:string>>"


def keyed(docs: DataFrame, config: SkimConfig) -> DataFrame:
    """doc_id, cache_key of each document under a configuration."""
    found = labels.configured_labels(docs.sparkSession, config.label_mode, config.custom_labels)
    named = ["auto"] if found is None else [r.key for r in found.orderBy("ord").collect()]  # at most eight rows
    return docs.select("doc_id", state.cache_key(F.coalesce("text", F.lit("")), config.provider, config.model_name, config.label_mode, named).alias("cache_key"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _label_array(ordered: DataFrame) -> DataFrame:
    """doc_id, labels from rows doc_id, ord, key, name, color."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "key", "name", "color")))
    return ordered.groupBy("doc_id").agg(F.transform(rows, lambda x: F.struct(x["key"].alias("key"), x["name"].alias("name"), x["color"].alias("color"))).cast(_LABELS).alias("labels"))


def _first_labels(spark: SparkSession, todo: DataFrame, config: SkimConfig, discovered: DataFrame | None) -> DataFrame:
    """todo with `labels`: those of the partial run, else found, else configured."""
    fixed = labels.configured_labels(spark, config.label_mode, config.custom_labels)
    fixed = [(r.key, r.name, r.color) for r in (labels.default_labels(spark) if fixed is None else fixed).orderBy("ord").collect()]  # at most eight rows
    default = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(c).alias("color")) for k, n, c in fixed)).cast(_LABELS)
    kept = F.when(F.size("labels") > 0, F.col("labels"))
    if config.label_mode == "auto" and discovered is not None:
        found = _label_array(labels.discovered_labels(discovered, ["doc_id"])).withColumnRenamed("labels", "found")
        return todo.join(found, "doc_id", "left").withColumn("labels", F.coalesce(kept, "found", default)).drop("found")
    return todo.withColumn("labels", F.coalesce(kept, default))


def _by_document(sents: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*_FIELDS)))
    return sents.groupBy("doc_id").agg(ordered.alias("sentences"), F.count_if("core").cast("int").alias("core_count"))


def resume(
    docs: DataFrame,
    sents: DataFrame,
    config: SkimConfig,
    path: str,
    selector_of: Callable[[DataFrame], select.Selector] = select.HeuristicSelector,
    *,
    discovered: DataFrame | None = None,
    items: DataFrame | None = None,
    adaptive_replies: DataFrame | None = None,
    reduce_replies: DataFrame | None = None,
    summary_replies: DataFrame | None = None,
    regenerate: bool = False,
) -> DataFrame:
    """State rows of docs (doc_id, text), a row each, after this run; written to `path`.

    sents: candidates as text_sentences gives them.  selector_of makes a selector from
    the chunks; its replies are written before use, so it is asked once.  In mode auto,
    works that `items` (doc_id, item_type, is_epub) or their length call long go by
    adaptive_replies, the others by the labels in `discovered` (doc_id, json).
    regenerate drops the state of these documents first.  `path`.work holds tables of
    the run and goes with it."""
    spark, work = docs.sparkSession, f"{path}.work"
    keys = _written(keyed(docs, config), f"{work}/keys")
    if regenerate:
        state.delete_state(spark, path, keys)
    shared = keys.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))
    had = state.read_state(spark, path).drop("doc_id", "prompt_version")
    todo = shared.join(had, "cache_key", "left").where(~F.coalesce("complete", F.lit(False)))
    todo = _first_labels(spark, todo, config, discovered)
    todo = todo.withColumn("classified_count", F.coalesce("classified_count", F.lit(0))).withColumn("chunk_budget", F.coalesce("chunk_budget", F.lit(config.selection_budget)))
    todo = _written(todo, f"{work}/todo")

    open_sents = sents.join(todo.select("doc_id", "chunk_budget"), "doc_id")
    spans = open_sents.groupBy("doc_id").agg((F.max("page_index") + 1).cast("int").alias("page_span"))
    grown = None
    if config.label_mode == "auto":
        kinds = spans.join(items, "doc_id", "left") if items is not None else spans.withColumn("item_type", F.lit(None).cast("string")).withColumn("is_epub", F.lit(False))
        long = kinds.where(labels.uses_evolving_labels(F.col("item_type"), F.coalesce("is_epub", F.lit(False)), F.col("page_span"))).select("doc_id")
        grown = open_sents.join(long, "doc_id", "left_semi").drop("chunk_budget")
        open_sents = open_sents.join(long, "doc_id", "left_anti")

    chunked = _written(budget.chunks(open_sents, F.col("chunk_budget")).drop("chunk_budget"), f"{work}/chunks")
    sizes = chunked.groupBy("doc_id", F.col("chunk_id").alias("unit_id")).agg(F.count("*").alias("size"))
    begin = budget.resume_unit(sizes.join(todo.select("doc_id", "classified_count"), "doc_id"))
    asked = prompts.selection_requests(chunked).join(begin, "doc_id").where("chunk_id >= next_unit").drop("next_unit")
    selector = selector_of(chunked)
    select.require_consent(selector, config.consent)
    replies = _written(selector.select(asked), f"{work}/replies")
    picked, failed = select.chosen(replies, asked, todo.select("doc_id", F.inline("labels")))
    stop = failed.groupBy("doc_id").agg(F.min("chunk_id").alias("stop"))
    done = sizes.join(stop, "doc_id", "left").where(F.col("stop").isNull() | (F.col("unit_id") < F.col("stop"))).groupBy("doc_id").agg(F.sum("size").cast("int").alias("classified"))
    picked = picked.join(stop, "doc_id", "left").where(F.col("stop").isNull() | (F.col("chunk_id") < F.col("stop")))
    picked = picked.select("doc_id", "chunk_id", F.col("id").alias("local_id"), "label", F.col("importance").alias("confidence"))
    new = chunked.join(picked, ["doc_id", "chunk_id", "local_id"]).withColumn("core", F.lit(False)).select("doc_id", *_FIELDS)
    usage = validate.token_usage(replies)
    found = None
    if grown is not None and adaptive_replies is not None:
        run = skim_evolving(grown, config, adaptive_replies)
        new = new.unionByName(run.classified.select("doc_id", *_FIELDS))
        usage = usage.unionByName(run.state.select("doc_id", "tokens_in", "tokens_out").where("tokens_in is not null"))
        first = run.classified.groupBy("doc_id", F.col("label").alias("key")).agg(F.min_by("label_name", "sent_id").alias("name"), F.min("sent_id").alias("at"))
        place = F.transform(F.array_sort(F.collect_list(F.struct("at", "key", "name"))), lambda x, i: F.struct(x["key"].alias("key"), x["name"].alias("name"), labels.palette(i).alias("color")))
        found = first.groupBy("doc_id").agg(place.cast(_LABELS).alias("grown"))  # at most MOST_EVOLVING a document
        done = done.unionByName(grown.groupBy("doc_id").agg(F.count("*").cast("int").alias("classified")))
    elif grown is not None:  # nobody has read them yet
        stop = stop.unionByName(grown.select("doc_id").distinct().withColumn("stop", F.lit(0)))

    earlier = todo.select("doc_id", F.inline("sentences"))
    chosen = _written(earlier.unionByName(new), f"{work}/chosen")
    head = todo.select("doc_id", "cache_key", "reduced", "tldr", "labels", "saved_keys", "chunk_budget", F.coalesce("tokens_in", F.lit(0)).alias("was_in"), F.coalesce("tokens_out", F.lit(0)).alias("was_out"))
    head = head.join(stop, "doc_id", "left").join(done, "doc_id", "left").join(spans, "doc_id", "left").join(usage, "doc_id", "left").withColumn("complete", F.col("stop").isNull())
    if reduce_replies is not None:
        ready = chosen.groupBy("doc_id").agg(F.count("*").alias("picks")).where(F.col("picks") >= REDUCED_FROM)
        ready = ready.join(head.where(F.col("complete") & ~F.coalesce("reduced", F.lit(False))), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("now"))
        narrated = reduce_core(chosen.join(ready, "doc_id", "left_semi"), reduce_replies)
        chosen = chosen.join(ready, "doc_id", "left_anti").unionByName(narrated.select("doc_id", *_FIELDS))
        head = head.join(ready, "doc_id", "left").withColumn("reduced", F.coalesce("now", "reduced")).drop("now")
    if found is not None:
        head = head.join(found, "doc_id", "left").withColumn("labels", F.coalesce("grown", "labels")).drop("grown")
    if config.summaries and summary_replies is not None:
        pages = segment.lines(docs).join(head.where("complete").select("doc_id"), "doc_id", "left_semi")
        said, _ = summarize(pages, head.where("tldr is not null").select("doc_id", "tldr"), summary_replies)
        head = head.drop("tldr").join(said, "doc_id", "left")
    rows = head.join(_by_document(chosen), "doc_id", "left").select(
        "doc_id", F.lit(vocab.PROMPT_VERSION).alias("prompt_version"), "complete", F.coalesce("classified", F.lit(0)).alias("classified_count"), F.coalesce("page_span", F.lit(0)).alias("page_span"),
        (F.col("was_in") + F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), (F.col("was_out") + F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
        F.coalesce("reduced", F.lit(False)).alias("reduced"), F.coalesce("core_count", F.lit(0)).alias("core_count"), "chunk_budget", "saved_keys", "tldr", "labels",
        F.coalesce("sentences", F.array().cast(f"array<{state.SENTENCE}>")).alias("sentences"), "cache_key",
    )
    state.write_state(_written(rows, f"{work}/rows"), path)
    at = spark._jvm.org.apache.hadoop.fs.Path(work)
    out = state.read_state(spark, path).drop("doc_id").join(keyed(docs, config), "cache_key")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return out


def shown(rows: DataFrame, config: SkimConfig) -> DataFrame:
    """What a reader sees of state rows: the view of the configuration, less its hidden
    labels, under the label names and colours of each document."""
    sents = rows.select("doc_id", F.inline("sentences"))
    names = rows.select("doc_id", F.inline("labels")).select("doc_id", F.col("key").alias("label"), F.col("name").alias("label_name"), "color")
    viewed = view.view(sents, config.view == "core").join(names, ["doc_id", "label"])
    hidden: Column = F.array_contains(labels.hidden_labels(F.lit(config.hidden_labels)), F.col("label"))
    return viewed.where(~hidden).select("doc_id", "sent_id", "page_index", "start_char", "end_char", "color", "label_name", "text")
