"""Structured Streaming forms of the stateless and small-state operators.

The lexicon classifier's inline form, the thresholds and the projections are
row-local, so they run on a stream unchanged. Confusion counts over a stream
are a global streaming aggregate whose state is five counters. A caller that
names its checkpoint location resumes there after a restart; without one, a run
is on its own, under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from modlens.operators.evaluate import confusion_aggs
from modlens.operators.lexicon import lexicon_score
from modlens.session import scratch_path


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType | str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """A directory of parquet files as a stream (schema declared, no inference)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def score_stream(stream: DataFrame, lexicon_rows: Sequence[tuple], key: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """Lexicon classifier on a stream (inline form only: no explode, no state)."""
    return lexicon_score(stream, list(lexicon_rows), key=key, text_col=text_col,
                         lang_col=lang_col, threshold=threshold, method="inline")


def confusion_stream(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Running n / tp / fp / fn / tn over a stream (complete or update mode)."""
    return scored.groupBy().agg(*confusion_aggs(label, pred))


def run_available(df: DataFrame, name: str, sink_path: str | None = None,
                  output_mode: str = "append", fmt: str = "parquet",
                  checkpoint: str | None = None) -> tuple[StreamingQuery, str]:
    """Process everything available now, then stop; returns the query and the sink path.

    A later call with the same ``checkpoint`` and ``sink_path`` takes only what is new.
    """
    spark = df.sparkSession
    sink = sink_path or scratch_path(spark, f"stream-{name}")
    ckpt = checkpoint or scratch_path(spark, f"stream-{name}-checkpoint")
    writer = (df.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
              .trigger(availableNow=True))
    if fmt == "memory":
        q = writer.format("memory").queryName(name).start()
    else:
        q = writer.format(fmt).option("path", sink).start()
    q.awaitTermination()
    return q, sink


def for_each_batch(df: DataFrame, name: str, fn: Callable[[DataFrame, int], None],
                   checkpoint: str | None = None) -> StreamingQuery:
    """Run ``fn(batch_df, batch_id)`` on every micro-batch. With a ``checkpoint`` a restarted call goes on
    from there; the last batch may come again under its id, so ``fn`` should be idempotent by id."""
    ckpt = checkpoint or scratch_path(df.sparkSession, f"stream-{name}-checkpoint")
    q = (df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
         .foreachBatch(fn).start())
    q.awaitTermination()
    return q
