"""Stream = batch for the stateless lexicon classifier; streaming confusion counts."""

from pyspark.sql import functions as F

from modlens.plans import inputs as I
from modlens.plans.catalog import lex_score
from modlens.session import scratch_path
from modlens.streaming import confusion_stream, read_parquet_stream, run_available, score_stream

from conftest import SF01


def test_stream_equals_batch(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    src = scratch_path(spark, "stream-src")
    docs.repartition(4).write.parquet(src)
    stream = read_parquet_stream(spark, src, docs.schema, max_files_per_trigger=1)
    scored = score_stream(stream, I.LEXICON_ROWS).select("doc_id", "hits", "toxicity", "pred")
    q, path = run_available(scored, "lex_stream_test")
    out = spark.read.parquet(path).withColumn("toxicity", F.round("toxicity", 6))
    batch = lex_score(spark, SF01)
    assert out.count() == batch.count() and out.exceptAll(batch).count() == 0
    assert len(q.recentProgress) >= 2

    # a named checkpoint resumes: the second run takes only the new file
    sink, ckpt = scratch_path(spark, "resumed"), scratch_path(spark, "resumed-checkpoint")
    run_available(scored, "resume_test", sink, checkpoint=ckpt)
    docs.limit(7).withColumn("doc_id", F.col("doc_id") + 10 ** 6).coalesce(1).write.mode("append").parquet(src)
    run_available(scored, "resume_test", sink, checkpoint=ckpt)
    assert spark.read.parquet(sink).count() == docs.count() + 7

    stream = read_parquet_stream(spark, src, docs.schema).where("doc_id < 1000000")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    cs = confusion_stream(score_stream(stream, I.LEXICON_ROWS).join(labels, "doc_id"))
    run_available(cs, "conf_stream_test", output_mode="complete", fmt="memory")
    r = spark.sql("SELECT * FROM conf_stream_test").first()
    b = lex_score(spark, SF01).join(labels, "doc_id")
    assert r["n"] == b.count()
    assert r["tp"] == b.where((F.col("label") == 1) & (F.col("pred") == 1)).count()
