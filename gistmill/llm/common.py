"""Shared helpers: tables in the shared folder, folds, labelled samples, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_ROWS = 1_000
SAMPLE_BYTES = 64 << 20
#: Parquet asks after every row, not after 100, whether a row group is full: rows of
#: binary columns can have many megabytes each, and writers and readers hold a group.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), in which this application
    has a folder that goes with it.  Only a local session may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    own = f"{path.rstrip('/')}/gistmill-{spark.sparkContext.applicationId}"
    if own not in _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _made.add(own)
    return own


_made: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH_ROWS rows at a time, unless the session has a setting
    of its own: whole texts come with them, and workers keep what they once took."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of `by`,
    and read it again: its lineage ends there, and a lost executor costs only a
    second read.  Tables with binary columns get small row groups."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.options(**(LARGE_ROWS if "binary" in dict(df.dtypes).values() else {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def first_by_hash(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, the first in the order of a hash of `keys`; a hash
    threshold set from the count leaves few rows to sort."""
    n = df.count()
    if n > most:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int((1.2 * most + 100) / n * (1 << 40)))
    return df.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)), *keys).limit(most)


def largest(df: DataFrame, count: str, most: int, *, fill: str | None = None) -> DataFrame:
    """The rows whose count reaches the least power of two that at most `most` rows
    reach, found from a histogram of at most 64 rows; nothing is sorted.  With `fill`
    the next level gives what is still missing, by count and then by a hash of
    that column (short by a little, never over)."""
    level = F.floor(F.log2(F.col(count))).cast("int")
    rows = sorted(((r.level, r.n) for r in df.where(F.col(count) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, 62
    for lev, n in rows:
        if held + n > most:
            break
        held, least = held + n, lev
    top = F.col(count) >= F.lit(1 << least).cast("long")
    below = [lev for lev, _ in rows if lev < least]
    if fill is None or not below:
        return df.where(top)
    # counts of the next level, which has at most as many as its width and its rows
    next_level = df.where((level == below[0]) & (F.col(count) > 0)).groupBy(F.col(count).alias("c")).agg(F.count("*").alias("n"))
    for c, n in sorted(((r.c, r.n) for r in next_level.collect()), reverse=True):
        if held + n > most:
            room = most - held
            part = F.pmod(F.xxhash64(fill), F.lit(1 << 40)) < int(max(0.0, room - 4 * room**0.5) / n * (1 << 40))
            return df.where(top | (F.col(count) > c) | ((F.col(count) == c) & part))
        held += n
    return df.where(top)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, left_out: int = 0, extra: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label, extra columns) of at most `per_class` rows and SAMPLE_BYTES
    of text of each class: the first rows in the order of a hash of the id, none from
    fold `left_out`; where these pass the bytes, the longest of them go, so one long
    text costs no other row.  A class's shortest is taken whatever its length.

    Null labels and ids are passed over; a doc_id with several labels takes the
    largest; of repeated documents the row with the largest text is kept, so reruns
    agree.  The second result counts all labelled ids by class, for undoing the
    balance of the sample.
    """
    small_batches(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    ids = ids.where(fold(F.col("doc_id")) != left_out)
    picked = [first_by_hash(ids.where(F.col("label") == v), per_class, "doc_id") for v in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows
    totals = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    rows = docs.select("doc_id", "text", *extra).join(few, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.max(F.struct("text", *extra)).alias("row")).select("doc_id", "label", "row.*")  # 2 * per_class rows
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    upto = Window.partitionBy("label").orderBy(size, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.sum(size).over(upto))
    return rows.where(F.col("__before").isNull() | (F.col("__before") + size <= SAMPLE_BYTES)).drop("__before"), totals


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the
    smallest node reachable.

    Alternates large-star and small-star rounds; each round groups by node with
    partial aggregation and is written to a table.  Joins on a hub are left to
    adaptive skew handling.  The driver sees one number a round.
    """
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = table(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), label)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
