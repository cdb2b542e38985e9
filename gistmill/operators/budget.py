"""Token budgets: estimates, chunks, bands and the resume cursor.

Chunking depends on order and carries a tail back, so it runs document by document in
Python, many in a batch; sentences go through once and are not joined again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gistmill.operators.documents import through

TOKEN_CHARS = 3.5
SENTENCE_OVERHEAD = 20


def tokens(chars: Column) -> Column:
    """Estimate for the summed length (with overhead) of some sentences."""
    return F.ceil(chars / F.lit(TOKEN_CHARS))


def token_estimate(sents: DataFrame, *keys: str) -> DataFrame:
    return sents.groupBy(*keys).agg(tokens(F.sum(F.length("text") + SENTENCE_OVERHEAD)).alias("tokens"))


def _cost(lengths: list[int]) -> int:
    return -(-2 * sum(n + SENTENCE_OVERHEAD for n in lengths) // 7)


def _starts(sizes: list[int], moved: list[bool], budget: int, lo: int, hi: int) -> list[int]:
    """Where chunks of the sentences lo to hi start.  A chunk that overflows ends at its
    latest change of place if that lies past 40 % of it; what follows carries over."""
    starts, begin, spent, change = [lo], lo, 0, lo
    for i in range(lo, hi):
        cost = -(-2 * sizes[i] // 7)
        if i > begin:
            if moved[i]:
                change = i
            if spent + cost > budget:
                begin = change if change - begin > 0.4 * (i - begin) else i
                starts.append(begin)
                spent, change = -(-2 * sum(sizes[begin:i]) // 7), begin
        spent += cost
    return starts


def chunk_ids(lengths: list[int], places: list[tuple], budget: int) -> list[int]:
    """A chunk number for each sentence."""
    if not lengths:
        return []
    moved = [False, *(x != y for x, y in zip(places[1:], places, strict=False))]
    starts = _starts([n + SENTENCE_OVERHEAD for n in lengths], moved, budget, 0, len(lengths))
    return (np.searchsorted(starts, np.arange(len(lengths)), "right") - 1).tolist()


_HELPERS = ("__size", "__moved", "__budget", "__band")


def _cut(sents: DataFrame, budget: Column, named: str, band: Column | None = None) -> DataFrame:
    """sents with `named` and local_id: chunks, numbered within the document, of the
    document or of each of its bands; a band within the budget is one chunk."""
    one = Window.partitionBy("doc_id").orderBy("sent_id")
    place = F.struct("section", "page_index")
    moved = ~F.lag(place).over(one).eqNullSafe(place)
    helpers = [F.coalesce(F.length("text") + SENTENCE_OVERHEAD, F.lit(SENTENCE_OVERHEAD)), moved, budget.cast("long"), F.lit(0) if band is None else band]
    columns = ["doc_id", "sent_id", *(c for c in sents.columns if c not in ("doc_id", "sent_id"))]
    schema = StructType([*sents.select(columns).schema.fields, StructField(named, IntegerType()), StructField("local_id", IntegerType())])
    banded = band is not None

    def work(made: pa.Table, bounds: np.ndarray) -> pa.Table:
        sizes, limits = made["__size"].to_pylist(), made["__budget"].to_numpy()
        moved, bands = made["__moved"].to_pylist(), made["__band"].to_numpy()
        cuts = np.union1d(bounds, np.flatnonzero(bands[1:] != bands[:-1]) + 1).tolist()
        starts: list[int] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            limit = int(limits[lo])
            if banded and -(-2 * sum(sizes[lo:hi]) // 7) <= limit:
                starts.append(lo)
            else:
                starts += _starts(sizes, moved, limit, lo, hi)
        at, row = np.array(starts, np.int64), np.arange(len(sizes))
        nth = np.searchsorted(at, row, "right") - 1
        first = np.repeat(np.searchsorted(at, bounds[:-1]), np.diff(bounds))
        made = made.drop_columns(list(_HELPERS))
        return made.append_column(named, pa.array((nth - first).astype(np.int32))).append_column("local_id", pa.array((row - at[nth]).astype(np.int32)))

    return through(sents.select(*columns, *(c.alias(n) for c, n in zip(helpers, _HELPERS, strict=True))), "sent_id", work, schema)


def chunks(sents: DataFrame, budget: int | Column) -> DataFrame:
    """sents (doc_id, sent_id, page_index, text, section) with chunk_id and local_id.
    A budget that is a column is the same in all rows of a document."""
    return _cut(sents, budget if isinstance(budget, Column) else F.lit(budget), "chunk_id")


def chunk_guard(chunked: DataFrame, budget: int) -> DataFrame:
    """Chunks whose estimate is over 1.2 times the budget: these must not be asked."""
    return token_estimate(chunked, "doc_id", "chunk_id").where(F.col("tokens") > budget * F.lit(1.2))


def _bands_of(n: Column, span: Column) -> Column:
    by_size = F.floor(n / 6)
    return F.greatest(F.lit(3), F.least(F.lit(12), F.floor(span / F.lit(1.8) + 0.5), F.when(by_size == 0, F.lit(3)).otherwise(by_size))).cast("int")


def _band_at(nth: Column, n: Column, bands: Column) -> Column:
    """The band of the sentence before which nth others of its n stand."""
    return F.floor(nth / F.ceil(n / bands)).cast("int")


def band_plan(sents: DataFrame) -> DataFrame:
    """doc_id, n, span, bands, target: how many bands, and how many items in all."""
    d = sents.groupBy("doc_id").agg(F.count("*").alias("n"), (F.max("page_index") + 1).alias("span"))
    target = F.least(F.col("span") * 3, F.greatest(F.lit(6), F.floor(F.col("span") * F.lit(1.5) + 0.5)))
    return d.withColumn("bands", _bands_of(F.col("n"), F.col("span"))).withColumn("target", target.cast("int"))


def per_unit(target: Column, units: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(target / units + 0.5)).cast("int")


def bands(sents: DataFrame, plan: DataFrame) -> DataFrame:
    """sents with band_id: contiguous runs of ceil(n / bands) sentences."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")) - 1
    out = sents.join(plan.select("doc_id", "n", "bands"), "doc_id")
    return out.withColumn("band_id", _band_at(place, F.col("n"), F.col("bands"))).drop("n", "bands")


def banded_chunks(sents: DataFrame, budget: int) -> DataFrame:
    """Bands as units; a band over the budget is cut into chunks.  unit_id is dense."""
    every = Window.partitionBy("doc_id")
    n, span = F.count("*").over(every), F.max("page_index").over(every) + 1
    place = F.row_number().over(every.orderBy("sent_id")) - 1
    planned = sents.withColumns({"__n": n, "__span": span, "__place": place})
    banded = planned.withColumn("band_id", _band_at(F.col("__place"), F.col("__n"), _bands_of(F.col("__n"), F.col("__span")))).drop("__n", "__span", "__place")
    return _cut(banded, F.lit(budget), "unit_id", F.col("band_id"))


def resume_unit(units: DataFrame) -> DataFrame:
    """doc_id, next_unit from rows (doc_id, unit_id, size, classified_count): whole
    units whose running size is covered are done."""
    upto = Window.partitionBy("doc_id").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("size").over(upto) <= F.col("classified_count")
    return units.withColumn("done", done).groupBy("doc_id").agg(F.count_if("done").cast("int").alias("next_unit"))
