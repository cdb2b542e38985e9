"""Label sets: defaults, custom and discovered labels, reconciliation, hidden labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.functions import vocab
from gistmill.functions.text import label_slug, trim

LABEL = "key string, name string, color string, description string, anti_description string, examples array<string>, ord int"
MOST_CUSTOM, MOST_DISCOVERED, MOST_EVOLVING = 8, 6, 8
_RAW = "array<struct<key:string,name:string,color:string,description:string,antiDescription:string,examples:array<string>>>"


def default_labels(spark: SparkSession) -> DataFrame:
    rows = [(k, n, c, d, a, [], i) for i, (k, n, c, d, a) in enumerate(vocab.DEFAULT_LABELS)]
    return spark.createDataFrame(rows, LABEL)


def configured_labels(spark: SparkSession, mode: str, custom_json: str) -> DataFrame | None:
    """The label set of a mode: None where labels are found in the document (auto), the
    custom set where it is valid, else the default."""
    if mode == "auto":
        return None
    if mode == "custom":
        one = spark.createDataFrame([(0, custom_json or "")], "__set int, json string")
        parsed = custom_labels(one, ["__set"]).drop("__set")
        if not parsed.isEmpty():  # at most eight rows
            return parsed
    return default_labels(spark)


def palette(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, vocab.PALETTE)), (i % len(vocab.PALETTE) + 1).cast("int"))


def _exploded(sets: DataFrame, keys: list[str], most: int) -> DataFrame:
    rows = sets.select(*keys, F.posexplode(F.slice("raw", 1, most)).alias("ord", "e"))
    key = F.substring(F.regexp_replace(F.lower("e.key"), "[^a-z]", ""), 1, 12)
    return rows.withColumn("key", key).withColumn("bad", F.coalesce(key.isin("", "none"), F.lit(True)))


def custom_labels(sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and label columns of each set in `json`; a set with one bad, repeated or
    reserved key gives no rows, nor does text that is no JSON array."""
    ok = F.col("json").rlike(r"(?s)^\s*\[") & F.try_parse_json("json").isNotNull()
    rows = _exploded(sets.where(ok).withColumn("raw", F.from_json("json", _RAW)), keys, MOST_CUSTOM)
    every = Window.partitionBy(*keys)
    again = F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ord")) > 1
    rows = rows.withColumn("again", again).withColumn("spoilt", F.bool_or(F.col("bad") | F.col("again") | F.col("e.name").isNull()).over(every)).where(~F.col("spoilt"))
    color = F.when(F.col("e.color").rlike(r"^\d+,\s*\d+,\s*\d+$"), F.col("e.color")).otherwise(palette(F.col("ord")))
    text = F.substring(F.when(F.coalesce("e.description", F.lit("")) == "", F.col("e.name")).otherwise(F.col("e.description")), 1, 200)
    anti = F.when(F.trim(F.coalesce("e.antiDescription", F.lit(""))) != "", F.substring("e.antiDescription", 1, 200))
    examples = F.transform(F.slice(F.filter(F.coalesce("e.examples", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, 3), lambda x: F.substring(x, 1, 200))
    return rows.select(*keys, "key", F.substring("e.name", 1, 24).alias("name"), color.alias("color"), text.alias("description"), anti.alias("anti_description"), examples.alias("examples"), "ord")


def discovered_labels(sets: DataFrame, keys: list[str]) -> DataFrame:
    """As custom_labels for replies {"labels": [...]}: at least two entries, the first
    six, a missing field spoils the set, bad keys are passed over, two must be left."""
    raw = F.from_json("json", f"labels {_RAW}")["labels"]
    rows = _exploded(sets.withColumn("raw", raw).where(F.size("raw") >= 2), keys, MOST_DISCOVERED)
    every = Window.partitionBy(*keys)
    missing = F.col("e.key").isNull() | F.col("e.name").isNull() | F.col("e.description").isNull()
    rows = rows.withColumn("spoilt", F.bool_or(missing).over(every)).where(~F.col("spoilt") & ~F.col("bad"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "key").orderBy("ord"))).where("nth = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1).withColumn("left", F.count("*").over(every)).where("left >= 2")
    return rows.select(*keys, "key", F.substring("e.name", 1, 24).alias("name"), palette(F.col("place")).alias("color"), F.substring("e.description", 1, 200).alias("description"), F.lit(None).cast("string").alias("anti_description"), F.array().cast("array<string>").alias("examples"), F.col("place").alias("ord"))


def hidden_labels(c: Column) -> Column:
    """A JSON array of label keys; anything else hides nothing."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def uses_evolving_labels(item_type: Column, is_epub: Column, pages: Column) -> Column:
    """Books and other long works find their labels as they are read."""
    return F.coalesce(item_type.isin(vocab.BOOK_TYPES), F.lit(False)) | is_epub | (pages > 40)


def resolve_label(name: str, known: list[tuple[str, str]]) -> str:
    """The key for a label that a selector named, adding it to `known` (key, name)
    while there is room."""
    slug = "".join(ch for ch in name.lower() if "a" <= ch <= "z")[:12] or "topic"
    for key, shown in known:
        if key == slug or shown.lower() == name.strip().lower():
            return key
    if len(known) < MOST_EVOLVING:
        known.append((slug, name.strip()[:24]))
        return slug
    return next((key for key, _ in known if key in slug or slug in key), known[0][0])


def reconcile(selected: DataFrame) -> DataFrame:
    """selected (doc_id, chunk_id, id, label, importance) with the label replaced by a
    key, chunks in order: a fold over each document's selections."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk_id", "id"]).reset_index(drop=True)
        known: list[tuple[str, str]] = []
        pdf["key"] = [resolve_label(name, known) for name in pdf["label"]]
        names = dict(known)
        pdf["name"] = [names[k] for k in pdf["key"]]
        return pdf[["doc_id", "chunk_id", "id", "key", "name", "importance"]]

    return selected.groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_id int, id long, key string, name string, importance double")


KNOWN = "array<struct<key:string,name:string>>"
_NAMED = "array<struct<id:bigint,key:string,name:string,importance:double>>"


def fold(selected: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, named (id, key, name, importance in order), known: one unit's selection of
    each document with labels replaced by keys, in order, as resolve_label does it.
    selected: doc_id, id, label, importance; known: doc_id, known (KNOWN), for all
    documents of the unit."""
    picks = F.array_sort(F.collect_list(F.struct("id", "label", "importance")))
    rows = known.join(selected.groupBy("doc_id").agg(picks.alias("picks")), "doc_id", "left")

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def step(acc, p):
        seen = acc["known"]
        row = lambda w, same: once(F.struct(F.get(same, 0).alias("same"), (F.isnull(F.get(same, 0)) & (F.size(seen) < MOST_EVOLVING)).alias("adds")), lambda m: add(w, m))

        def add(w, m):
            near = F.filter(seen, lambda k: F.contains(w["key"], k["key"]) | F.contains(k["key"], w["key"]))
            new = F.struct(w["key"].alias("key"), w["name"].alias("name"))
            to = F.coalesce(m["same"], F.when(m["adds"], new), F.get(near, 0), F.get(seen, 0))
            named = once(to, lambda t: F.struct(p["id"].cast("bigint").alias("id"), t["key"].alias("key"), t["name"].alias("name"), p["importance"].cast("double").alias("importance")))
            return F.struct(F.when(m["adds"], F.array_append(seen, new)).otherwise(seen).cast(KNOWN).alias("known"), F.array_append(acc["named"], named).cast(_NAMED).alias("named"))

        words = F.struct(label_slug(p["label"]).alias("key"), F.substring(trim(p["label"]), 1, 24).alias("name"), F.lower(trim(p["label"])).alias("said"))
        return once(words, lambda w: once(F.filter(seen, lambda k: (k["key"] == w["key"]) | (F.lower(k["name"]) == w["said"])), lambda same: row(w, same)))

    start = F.struct(F.col("known").cast(KNOWN).alias("known"), F.array().cast(_NAMED).alias("named"))
    none = F.array().cast("array<struct<id:bigint,label:string,importance:double>>")
    out = rows.select("doc_id", F.aggregate(F.coalesce("picks", none), start, step).alias("acc"))
    return out.select("doc_id", "acc.named", "acc.known")


def known_before(reconciled: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, unit_id, known: names of the labels that earlier units of the document
    brought up, in that order, for each unit with any.  reconciled: as reconcile gives
    it; units: doc_id, unit_id.  A document has at most MOST_EVOLVING labels."""
    seen = reconciled.groupBy("doc_id", "key").agg(F.min(F.struct("chunk_id", "id", "name")).alias("first"))
    seen = seen.groupBy("doc_id").agg(F.array_sort(F.collect_list("first")).alias("seen"))
    before = F.filter("seen", lambda s: s["chunk_id"] < F.col("unit_id"))
    out = units.select("doc_id", "unit_id").distinct().join(seen, "doc_id").where(F.size(before) > 0)
    return out.select("doc_id", "unit_id", F.array_join(F.transform(before, lambda s: s["name"]), ", ").alias("known"))


def slugs(names: DataFrame, column: str) -> DataFrame:
    return names.select(column, label_slug(F.col(column)).alias("slug"))
