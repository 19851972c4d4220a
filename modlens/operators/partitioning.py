"""Partitioning helpers.

``spread`` gives CPU-heavy per-row work (tokenising long texts, regex, model
scoring) at least one partition per core. It looks at the number of files only
(no job, no planning of the input): from that many files on -- any large
input on a cluster -- it is a no-op; only small, few-file inputs pay one hash
shuffle on the key, which later joins and aggregations on the same key then
reuse. It is meant for a bare scan. An explicit partition count is not
coalesced away by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    if df.isStreaming:
        return df  # a stream's partitions come from its source and micro-batches
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
