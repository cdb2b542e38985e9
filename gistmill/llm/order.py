"""Running sums and ranks over whole tables without a task that takes all rows.

Both work on numbered parts of a table: each task knows its own rows, a small table
holds one row for each part, and sums over that one run in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import table

GROUP = 1024
FEW = 1 << 20
_ROW = (1 << 33) - 1


def before(sums: DataFrame, part: str, amount: str, *within: str) -> DataFrame:
    """sums (one row for each part, and each value of `within`) with the column
    `base`: the sum of `amount` over earlier parts.  Sums run within groups of GROUP
    parts, then over groups."""
    sums = sums.withColumn("__group", F.floor(F.col(part) / GROUP))
    own = ["__group", *within]
    inner = Window.partitionBy(*own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(*own).agg(F.sum(amount).alias("__sum"))
    groups = groups.select(*own, F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__earlier"))
    sums = sums.withColumn("__inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return sums.join(groups, own).withColumn("base", (F.col("__earlier") + F.col("__inner")).cast("long")).drop("__group", "__inner", "__earlier")


def joined(rows: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """rows joined to a table of parts, which is sent whole up to FEW rows and
    shuffled beyond (a part is no more than what one task read)."""
    parts = table(parts, "parts")
    return rows.join(F.broadcast(parts) if parts.count() <= FEW else parts, list(keys))


def ranked(df: DataFrame, order: list[Column], *within: str, label: str = "ranked") -> DataFrame:
    """df with `rank` (from 0) in the order of (within, order): rows are dealt by
    ranges and numbered where they lie.  With `within` the rank and the new column
    `rows` count by its values, else over all rows.  `within` columns hold no nulls."""
    keys = [F.col(c) for c in within] + order
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = table(placed, label)
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit(_ROW)))
    parts = placed.groupBy("__part", *within).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    parts = before(parts, "__part", "__n", *within)
    total = parts.groupBy(*within).agg(F.sum("__n").alias("rows"))
    parts = parts.join(total, list(within)) if within else parts.crossJoin(F.broadcast(total))  # one row
    placed = joined(placed, parts, "__part", *within)
    return placed.withColumn("rank", F.col("base") + F.col("__row") - F.col("__first")).drop("__at", "__part", "__row", "__first", "__n", "base")
