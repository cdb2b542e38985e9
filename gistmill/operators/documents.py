"""Work that goes through whole documents, many of them in one Arrow batch.

Rows are dealt by doc_id and come in order, so a task reads its documents one after
the other; the last of a batch is held until it ends.  One document's rows are in
memory at a time, beside a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NTH = "__nth"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole documents, with the rows where documents begin and the end."""
    held: list[pa.RecordBatch] = []

    def ready(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        made = pa.Table.from_batches(parts)
        ids, nth = made["doc_id"].to_numpy(), made[NTH].to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        if not np.array_equal(begins, np.flatnonzero(nth == 1)):
            raise ValueError("a document's rows are not together")
        return made.drop_columns([NTH]), np.append(begins, len(ids))

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.flatnonzero(batch.column(batch.schema.get_field_index(NTH)).to_numpy() == 1)
        if not len(begins):
            held.append(batch)
            continue
        last = int(begins[-1])
        parts = [*held, batch.slice(0, last)] if last else held
        if parts:
            yield ready(parts)
        held = [batch.slice(last)]
    if held:
        yield ready(held)


def through(rows: DataFrame, order: str, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType | str) -> DataFrame:
    """work(table, bounds) over all rows of doc_ids that are not null, by `order` within
    each: document i of a table has the rows bounds[i] to bounds[i + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, bounds in _whole(batches):
            yield from work(made, bounds).to_batches()

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    dealt = rows.where(F.col("doc_id").isNotNull()).withColumn(NTH, nth).sortWithinPartitions("doc_id", NTH)
    return dealt.mapInArrow(run, schema)
