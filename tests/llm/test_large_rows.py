"""Tables whose rows have megabytes each."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gistmill.llm.common import table


def test_row_groups_of_large_rows_are_small(spark):
    def blobs(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(1).bytes(3 << 20)], pa.binary())], ["x"])

    got = table(spark.range(0, 24, 1, 1).mapInArrow(blobs, "x binary"), "blobs")
    (path,) = glob.glob(got.inputFiles()[0].replace("file://", ""))
    parts = pq.ParquetFile(path).metadata
    assert max(parts.row_group(i).total_byte_size for i in range(parts.num_row_groups)) <= 20 << 20
    assert got.agg(F.count("*"), F.sum(F.length("x"))).first() == (24, 24 * (3 << 20))
