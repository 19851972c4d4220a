"""Text encoding to fixed-length id sequences (T1) and the token-length profile (T2).

Ids: 0 begin, 1 pad, 2 end, 3 unknown, then 4 + frequency rank of the word
(count desc, word asc). Tokens are truncated to ``max_len - 2`` *before* any
explode, so a 100k-word text costs at most ``max_len`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modlens.functions.columns import first_tokens, tokens
from modlens.operators.partitioning import spread
from modlens.operators.sampling import sorted_rank

BOS, PAD, EOS, UNK = 0, 1, 2, 3
FIRST_WORD_ID = 4


def vocabulary(df: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """(token, n, id) for every word with at least ``min_count`` occurrences."""
    counts = (spread(df.select(text_col)).select(F.explode(tokens(F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_count))
    ranked = sorted_rank(counts, [F.col("n").desc(), F.col("token").asc()], "_r")
    return ranked.select("token", "n", (F.col("_r") + F.lit(FIRST_WORD_ID - 1)).alias("id"))


#: Words that are broadcast: some 30 MB.
HEAD_SIZE = 400_000


def encode_fixed(df: DataFrame, vocab: DataFrame, key: str = "doc_id", text_col: str = "text",
                 max_len: int = 128, head_size: int = HEAD_SIZE) -> DataFrame:
    """(key, input_ids, attention_mask): [BOS] + ids + [EOS], truncated right and
    padded with PAD to ``max_len``; mask is 1 on non-pad positions.

    One row per input row: rows that share a key are told apart by their text. A NULL text counts as empty.

    Ids rank words by frequency, so the ``head_size`` most frequent words are a bounded table: it is
    broadcast, and a row whose words it has is encoded where it is read, without a shuffle. Only where the
    vocabulary is larger do the rarer words meet its rest in a shuffle, and their ids the
    row's others in another; no frequent word is a key there. The first words are then split off once for each of the two.
    """
    rows = spread(df.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text")), key)
    rows = rows.select(key, F.md5(F.col("_text").cast("binary")).alias("_t"), first_tokens("_text", max_len - 2).alias("_toks"))
    coded = rows.mapInArrow(_head_ids(vocab, head_size), StructType([
        rows.schema[key], *StructType.fromDDL("_t string, _ids array<int>, _rare array<struct<pos: int, token: string>>").fields]))
    if (vocab.agg(F.max("id")).first()[0] or 0) < FIRST_WORD_ID + head_size:
        return coded.select(key, *_framed(F.transform("_ids", lambda i: F.coalesce(i, F.lit(UNK))), max_len))
    tail = vocab.where(F.col("id") >= FIRST_WORD_ID + head_size).select("token", F.col("id").cast("int").alias("_id"))
    whole = coded.where(F.size("_rare") == 0).select(key, "_ids")
    some = coded.where(F.size("_rare") > 0)
    # rows equal in key and text have the same rare words at the same places
    found = (some.select(F.col(key).alias("_key"), F.col("_t").alias("_u"), F.inline("_rare")).join(tail, "token", "left")
             .groupBy("_key", "_u").agg(F.collect_set(F.struct("pos", F.coalesce("_id", F.lit(UNK)).alias("id"))).alias("_found")))
    known = F.filter(F.transform("_ids", lambda i, p: F.struct(p.alias("pos"), i.alias("id"))), lambda s: s["id"].isNotNull())
    merged = (some.join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_u")))
              .select(key, F.transform(F.array_sort(F.concat(known, "_found")), lambda s: s["id"]).alias("_ids")))
    return whole.unionByName(merged).select(key, *_framed(F.col("_ids"), max_len))


def _head_ids(vocab: DataFrame, head_size: int):
    """(key, digest, words) batches to (key, digest, ids, (place, word) of the words that the head lacks, whose
    ids are null). A batch looks up each distinct word once."""
    head = vocab.where(F.col("id") < FIRST_WORD_ID + head_size).select("token", F.col("id").cast("int").alias("id")).toArrow()
    shared = vocab.sparkSession.sparkContext.broadcast(dict(zip(head["token"].to_pylist(), head["id"].to_pylist())))

    def encode(batches):
        ids_of = shared.value
        for batch in batches:
            toks = batch.column(2)
            counts = toks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(counts)))
            words = toks.flatten().dictionary_encode()
            known = np.array([ids_of.get(w, -1) for w in words.dictionary.to_pylist()], np.int32)
            ids = known[words.indices.to_numpy()] if len(words) else np.empty(0, np.int32)
            rare = np.flatnonzero(ids < 0)
            row = np.searchsorted(edges, rare, side="right") - 1
            missing = pa.StructArray.from_arrays([pa.array((rare - edges[row]).astype(np.int32)),
                                                  words.take(pa.array(rare)).cast(pa.string())], ["pos", "token"])
            lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), values) for e, values in (
                (edges, pa.array(ids, pa.int32(), mask=ids < 0)), (np.searchsorted(rare, edges), missing))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], [batch.schema.names[0], "_t", "_ids", "_rare"])

    return encode


def _framed(word_ids: Column, max_len: int) -> list[Column]:
    """input_ids with begin, end and padding, and their mask."""
    seq = F.concat(F.array(F.lit(BOS)), word_ids, F.array(F.lit(EOS)))
    n_real = F.size(seq)
    n_pad = F.lit(max_len) - n_real
    return [F.concat(seq, F.array_repeat(F.lit(PAD), n_pad)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask")]


def encode_hashed(df: DataFrame, key: str = "doc_id", text_col: str = "text", max_len: int = 128,
                  buckets: int = 1 << 18) -> DataFrame:
    """``encode_fixed`` without a vocabulary: a word's id is 4 + the first 32 bits of its md5 modulo ``buckets``.

    Each row is encoded where it is read, so it runs on a stream as it does on a table, and a repeated key
    is as good as any. Words may share an id: a word clashes with one of n others with
    probability 1 - (1 - 1 / buckets)^n, 17 % at 50,000 words and 2^18 buckets, 1.2 % at 2^22. No word is unknown.
    """
    toks = F.slice(tokens(F.coalesce(F.col(text_col), F.lit(""))), 1, max_len - 2)
    number = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint")
    word_ids = F.transform(toks, lambda t: (F.pmod(number(t), F.lit(buckets)) + FIRST_WORD_ID).cast("int"))
    # the ids leave through a one-row generator, or every use of them would hash the words again
    return df.select(key, F.explode(F.array(word_ids)).alias("_ids")).select(key, *_framed(F.col("_ids"), max_len))


def truncation_profile(df: DataFrame, text_col: str = "text", max_len: int = 128,
                       percentiles: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Token-count profile: docs, mean, exact percentiles, max, and the share of
    texts longer than ``max_len - 2`` tokens (truncated by the encoder).

    Percentiles are exact: the smallest length whose cumulative count reaches
    ceil(p% of docs), read off a histogram of lengths (one row per distinct
    length, bounded by the longest text) rather than a sort of all rows.
    """
    hist = (spread(df.select(text_col)).select(F.size(tokens(F.col(text_col))).alias("len"))
            .groupBy("len").agg(F.count(F.lit(1)).alias("c")))
    w_all = Window.partitionBy()
    w_cum = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    h = (hist.withColumn("cum", F.sum("c").over(w_cum))
         .withColumn("total", F.sum("c").over(w_all)))
    aggs = [
        F.first("total").cast("bigint").alias("n_docs"),
        (F.sum(F.col("len") * F.col("c")) / F.first("total")).alias("mean_tokens"),
    ]
    for p in percentiles:
        need = F.floor((F.col("total") * F.lit(p) + F.lit(99)) / F.lit(100))
        aggs.append(F.min(F.when(F.col("cum") >= need, F.col("len"))).cast("bigint").alias(f"p{p}"))
    aggs += [
        F.max("len").cast("bigint").alias("max_tokens"),
        (F.sum(F.when(F.col("len") > max_len - 2, F.col("c")).otherwise(0)) / F.first("total"))
        .alias("share_truncated"),
    ]
    return h.agg(*aggs).withColumn("max_len", F.lit(max_len))
