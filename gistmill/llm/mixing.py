"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame only).

The size of a document is its number of words.  Sources, in code-point order with
null last, weigh WEIGHTS in turn and share SHARE of all words; a target stops at
REPEATS times its source's size and the excess is shared again by weight, which
has a closed form once sources are sorted by size over weight.

Slot t of the schedule maps the point t / phi mod 1 (whole-number arithmetic
modulo 2**31) through the cumulative targets to a source; the slots of a source
are ranked.  Each source's documents, shuffled by a hash of the id, form a stream
cut into blocks of BLOCK words; rank r takes block r modulo the number of blocks.
A source stops at the words of its target, so its last rank takes the first words
of a block only; the few ranks by which the schedule falls short of a target (a
source may be smaller than a block) are added at its end.  What a document gives is
the sum of its overlaps with what is taken, so it never exceeds REPEATS times its
size, and each source gives the whole words of its target.

Ranks and stream positions are sums in two levels (within small ranges, then over
ranges), so no task holds a whole source.  The driver sees three numbers.

Defined cases: a null text has size 0 and takes nothing; null doc_id and null
source are values like others (a null id is hashed as the word null); repeated
rows are each mixed; extra columns are not touched; without words all is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
_CELLS = 1024
_RANGE = 4096
_STEP, _MODULUS = 1327217885, 1 << 31


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sid, source, rows, source_size, target, lo, hi (its stretch of [0, 1))."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * repeats
    s = s.withColumn("all", F.sum("source_size").over(every) * F.lit(share)).withColumn("nth", F.row_number().over(ratio))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= cap)
    s = s.withColumn("water", F.min_by("level", F.when(~F.col("capped"), F.col("nth"))).over(every))
    s = s.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("water") * F.col("weight")))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(every)
    s = s.withColumn("hi", F.when(total > 0, F.sum("target").over(upto) / total).otherwise(F.lit(0.0)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
    return s.select("sid", "source", "rows", "source_size", "target", "lo", "hi")


def schedule(sources: DataFrame, slots: int, *, block: int = BLOCK) -> DataFrame:
    """sid, block, taken, part: how often the schedule takes each block of each source
    whole, and how many first words of it once more."""
    t = sources.sparkSession.range(slots).withColumn("u", (F.col("id") % _MODULUS * _STEP % _MODULUS) / F.lit(float(_MODULUS)))
    t = t.withColumn("cell", F.floor(F.col("u") * _CELLS))
    # each source's stretch by the cells it meets: at most sources + cells rows
    words, size = F.floor("target").cast("long"), F.col("source_size")
    sources = sources.withColumn("blocks", F.ceil(size / block)).withColumn("words", words).withColumn("cycles", F.when(size > 0, F.floor(words / size)).otherwise(0))
    sources = sources.withColumn("need", F.col("cycles") * F.col("blocks") + F.ceil((words - F.col("cycles") * size) / block))
    own = ["sid", "source_size", "blocks", "words", "need"]
    cells = sources.select(*own, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.floor(F.col("hi") * _CELLS))).alias("cell"))
    hit = t.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    hit = hit.select(*own, "id", F.floor(F.col("id") / _RANGE).alias("range"))
    counts = hit.groupBy("sid", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    short = sources.select(*own).join(counts.groupBy("sid").agg(F.sum("n").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    added = short.select(*own, F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    counts = counts.select("sid", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("sid", "range").orderBy("id")) - 1
    ranked = hit.withColumn("inner", rank).join(counts, ["sid", "range"]).withColumn("rank", F.col("before") + F.col("inner"))
    ranked = ranked.select(*own, "rank").unionByName(added).where(F.col("rank") < F.col("need"))
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
    left = F.col("words") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - F.col("block") * block
    ranked = ranked.withColumn("part", F.least("length", left))
    return ranked.groupBy("sid", "block").agg(F.count_if(F.col("part") == F.col("length")).alias("taken"), F.coalesce(F.max(F.when(F.col("part") < F.col("length"), F.col("part"))), F.lit(0)).alias("part"))


def mixed(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = table(docs.select("doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("order")), "sizes")
    sources = table(targets(sizes), "sources")
    words, rows = sources.agg(F.sum("target"), F.max("rows")).first()
    slots = int(-(-(words or 0) // block))
    digits = 0
    while (rows or 0) > _RANGE * 16**digits:
        digits += 1

    names = F.col("s.source").eqNullSafe(F.col("d.source"))
    placed = sizes.alias("d").join(sources.alias("s"), names).select("d.doc_id", "d.size", "d.order", "s.sid", "s.source_size", "s.target", F.substring("d.order", 1, digits).alias("range"))
    sums = placed.groupBy("sid", "range").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("sid", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(sums, ["sid", "range"]).withColumn("start", F.col("before") + F.col("inner"))
    placed = table(placed.select("doc_id", "sid", "start", "size", "source_size", "target"), "placed")

    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("sid", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    taken = pieces.join(schedule(sources, slots, block=block), ["sid", "block"])
    begin = F.col("block") * block
    overlap = lambda size: F.greatest(F.least(F.col("end"), begin + size) - F.greatest(F.col("start"), begin), F.lit(0))
    taken = taken.groupBy("sid", "start").agg(F.sum(overlap(F.lit(block)) * F.col("taken") + overlap(F.col("part"))).cast("long").alias("taken"))
    out = placed.where("size > 0").join(taken, ["sid", "start"], "left").unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def oracle(block: int = BLOCK) -> str:
    """The same in DuckDB SQL."""
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s0 AS (SELECT source, count(*) AS rows_, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, ([3, 1, 2])[((sid - 1) % 3 + 1)::INT] AS weight FROM s1),
s3 AS (
  SELECT *, row_number() OVER w AS nth,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM s2 WINDOW w AS (ORDER BY source_size::DOUBLE / weight, sid),
    b AS (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, level * weight >= source_size * 2 AS capped FROM s3),
s5 AS (SELECT *, CASE WHEN capped THEN (source_size * 2)::DOUBLE
    ELSE (SELECT level FROM s4 WHERE NOT capped ORDER BY nth LIMIT 1) * weight END AS target FROM s4),
s6 AS (SELECT *, sum(target) OVER (ORDER BY sid) / (SELECT sum(target) FROM s5) AS hi FROM s5),
s7 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, ceil(source_size / {block}.0)::BIGINT AS blocks, floor(target)::BIGINT AS words,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS cycles FROM s6),
s8 AS (SELECT *, cycles * blocks + ceil((words - cycles * source_size) / {block}.0)::BIGINT AS need FROM s7),
slots AS (SELECT id, (id % 2147483648 * 1327217885 % 2147483648)::DOUBLE / 2147483648 AS u
  FROM range(0, coalesce((SELECT ceil(sum(target) / {block})::BIGINT FROM s5), 0)) t(id)),
hits AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY id) - 1 AS rank FROM slots JOIN s7 ON u >= lo AND u < hi),
ranked AS (
  SELECT sid, rank FROM hits UNION ALL
  SELECT sid, unnest(range(have, greatest(have, need))) FROM (SELECT sid, need, (SELECT count(*) FROM hits h WHERE h.sid = s.sid) AS have FROM s8 s)),
parts AS (
  SELECT sid, block, length, least(length, words - (rank // blocks) * source_size - block * {block}) AS part
  FROM (SELECT sid, rank, rank % blocks AS block, least({block}, source_size - rank % blocks * {block}) AS length, words, source_size, blocks
        FROM ranked JOIN s8 USING (sid) WHERE rank < need)),
taken AS (SELECT sid, block, count(*) FILTER (part = length) AS times, coalesce(max(part) FILTER (part < length), 0) AS part FROM parts GROUP BY ALL),
placed AS (
  SELECT doc_id, size, sid, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY sid ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes d JOIN s7 s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (SELECT sid, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM placed WHERE size > 0),
sums AS (
  SELECT sid, start, sum((least(start + size, (block + 1) * {block}) - greatest(start, block * {block})) * times
    + greatest(0, least(start + size, block * {block} + part) - greatest(start, block * {block})))::BIGINT AS taken
  FROM pieces JOIN taken USING (sid, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken
FROM placed LEFT JOIN sums USING (sid, start)"""
