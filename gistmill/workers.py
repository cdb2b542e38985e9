"""Settings of Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Python workers give memory back to the system when they free it.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def give_back(spark: SparkSession) -> None:
    """WORKER_ENV for the workers of queries built from now on."""
    for key, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(key, value)
