from modlens.streaming.stream import (
    confusion_stream,
    for_each_batch,
    read_parquet_stream,
    run_available,
    score_stream,
)

__all__ = ["confusion_stream", "for_each_batch", "read_parquet_stream", "run_available", "score_stream"]
