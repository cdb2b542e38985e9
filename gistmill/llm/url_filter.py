"""URL filter: list rules, and association rules mined by FP-growth for the rest.

Host: after the first :// up to /, ?, # or the end, A-Z lowered; path: from there
up to ? or #; both empty without ://.  A list rule (host, path) fits its host and
all subdomains when the path starts with the rule's; the longest wins.

For urls without a list rule, tokens (host suffixes, host labels, path segments,
extension, query keys) are matched with association rules.  Spark's FP-growth
mines them from all labelled urls, those that a list rule judges, where tokens of
exactly the same urls count as one.  Rules that
conclude a label, with at least MIN_CONFIDENCE and MIN_SUPPORT, stay unless a more
general rule of the same label is as sure; none is dropped for its number.
Matching uses an inverted index: each rule hangs on its rarest tokens, a url meets
the rules of its tokens, and a rule all of whose tokens it holds fits.  The surest
fitting rule decides; without one the url is allowed.

DataFrame functions only.  Defined cases: a null url has empty host and path, no
rule and is allowed; repeated urls are judged once and returned for each row;
with no labelled url no rule is mined; extra columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import table

#: (host, path, verdict)
LIST = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(h: Column, p: Column, rules=LIST) -> Column:
    """The longest list rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rh, rp, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, h: Column, p: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("under="), F.array_join(F.slice(labels, i, n), ".")))
    hosts = F.transform(labels, lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[&=]")
    keys = F.transform(F.filter(query, lambda x, i: (i % 2 == 0) & (x != "")), lambda x: F.concat(F.lit("query="), x))
    ext = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1)
    extra = F.when(ext != "", F.array(F.concat(F.lit("type="), ext))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")), hosts, segments, keys, extra))


def mine_classes(labelled: DataFrame) -> DataFrame:
    """classes, verdict, confidence, support, rarest from rows (tokens, verdict).

    Frequent tokens of exactly the same rows - the labels of one host, say - make one
    class and are mined as one item: rules that differ in such tokens alone have equal
    figures, and their number is exponential in the class.  A rule fits a url that
    holds a token of each of its classes; `rarest` is the class with fewest rows.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.array_distinct("tokens").alias("tokens"), F.concat(F.lit(LABEL), "verdict").alias("said"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "classes array<array<string>>, verdict string, confidence double, support double, rarest array<string>")
    each = rows.select("row", F.explode("tokens").alias("token"))
    # two 64-bit digests of a token's rows: equal for equal sets of rows
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("y"))
    frequent = held.where(F.col("n") >= math.ceil(MIN_SUPPORT * n))
    classes = table(frequent.groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("class")).select(F.col("class")[0].alias("token"), "class", "n"), "classes")
    items = each.join(classes.select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("items"))
    baskets = rows.join(items, "row", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.col("said")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(table(baskets, "baskets"))
    rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = rules.select(F.array_sort("antecedent").alias("rule"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 100).alias("verdict"), "confidence", "support")
    rules = table(rules, "rules")
    wide = rules.select(F.col("rule").alias("w"), F.col("verdict").alias("wv"), F.col("confidence").alias("wc"))
    # a rule goes when a proper part of it is as sure of the same verdict
    implied = (F.col("verdict") == F.col("wv")) & (F.col("wc") >= F.col("confidence")) & (F.size("w") < F.size("rule")) & (F.size(F.array_except("w", "rule")) == 0)
    parts = rules.select("rule", "verdict", "confidence", F.explode("rule").alias("token"))
    gone = parts.join(wide.withColumn("token", F.element_at("w", 1)), "token").where(implied).select("rule", "verdict").distinct()
    rules = rules.join(gone, ["rule", "verdict"], "left_anti").withColumn("token", F.explode("rule"))
    out = rules.join(classes, "token").groupBy("rule", "verdict", "confidence", "support")
    return out.agg(F.sort_array(F.collect_list("class")).alias("classes"), F.min_by("class", F.struct("n", "token")).alias("rarest")).drop("rule")


def mine(labelled: DataFrame) -> DataFrame:
    """rule_tokens, verdict, confidence, support: the rules of `mine_classes` with a row
    for each choice of a token from each class."""
    empty = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("classes", empty, lambda done, some: F.flatten(F.transform(done, lambda d: F.transform(some, lambda t: F.array_append(d, t)))))
    return mine_classes(labelled).select(F.explode(choices).alias("t"), "verdict", "confidence", "support").select(F.array_sort("t").alias("rule_tokens"), "verdict", "confidence", "support")


def judged(pages: DataFrame, *, rules=LIST) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    url = F.col("url").cast("string")
    base = pages.select("page_id", url.alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    base = table(base.withColumn("fit", listed(F.col("host"), F.col("path"), rules)), "urls")
    each = base.where("url is not null").select("url", "host", "path", "fit").distinct().withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    mined = table(mine_classes(each.where("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict"))), "mined")
    free = each.where("fit is null").select("url", "tokens", F.explode("tokens").alias("token"))
    met = free.join(mined.withColumn("token", F.explode("rarest")), "token").where(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    best = met.groupBy("url").agg(F.max(F.struct("confidence", F.size("classes").alias("n"), "support", F.col("verdict").alias("v"))).alias("best"))
    out = base.join(best, "url", "left")
    verdict = F.coalesce("fit.verdict", "best.v", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
