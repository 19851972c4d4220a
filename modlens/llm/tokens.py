"""Token counts by separator scan over flat, unindexed token files.

Layout. A token file is a stream of big-endian words of 16 bits, or of 32 for a vocabulary of more than
50,367. Each document is its tokens, a few words that hold its 64-bit id (in so few bits each that they
can't look like the separator), and the separator. There is no index and no header. Spark's text
writer makes the files: a row is a document's bytes, and the line separator is the end-of-document
identifier, a word that is no token and whose bytes are a character (``0xC4BF``, or ``0x7F7F7F7F``).
Files hold at most ``DOCS_PER_FILE`` documents.

Scan. Files are cut into blocks of ``BLOCK`` words wherever that falls. Each block is searched for
separators with one vector comparison, on its own; boundaries are stitched by a prefix scan over a
file's blocks: the last separator before a block is a running maximum, a document's number a running
count. Only separator places leave a block.

Nulls and ties: a null or empty text has 0 tokens; a null id is kept as null; repeated rows are
separate documents; a very long text may cover many blocks; an empty table gives empty files.
"""

from __future__ import annotations

import base64
import importlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.llm.common import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 19


@dataclass(frozen=True)
class Layout:
    """Words of a token file. The id takes ``id_words`` words of ``id_bits`` bits; the bit after its last
    marks a null id."""

    kind: str
    separator: int
    text: str
    id_words: int
    id_bits: int

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize


NARROW = Layout(">u2", 0xC4BF, "\u013f", 5, 15)
WIDE = Layout(">u4", 0x7F7F7F7F, "\x7f" * 4, 3, 22)
DOCS_PER_FILE = 4096
_MADE: dict[int, object] = {}


def tokenizer(ranks: bytes):
    """The tokenizer of a ranks file's content; one per worker process."""
    key = hash(ranks)
    if key not in _MADE:
        tiktoken = importlib.import_module("tiktoken")
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _MADE[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _MADE[key]


def encode(encoder, text: str) -> np.ndarray:
    """The whole text's tokens. The encoder merges a long stretch with a heap, so time is near linear in it."""
    return encoder.encode_to_numpy(text, disallowed_special=())


def id_words(key: int | None, layout: Layout) -> list[int]:
    """The id's bits, lowest first; only the null mark for a null id."""
    u = 1 << 64 if key is None else key & ((1 << 64) - 1)
    return [u >> layout.id_bits * j & ((1 << layout.id_bits) - 1) for j in range(layout.id_words)]


def word_ids(words: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(ids, null flags) of rows of id words."""
    w = words.astype(np.uint64)
    out = np.zeros(len(w), np.uint64)
    for j in range(layout.id_words):
        out |= w[:, j] << np.uint64(layout.id_bits * j)
    null = w[:, -1] >> np.uint64(64 - layout.id_bits * (layout.id_words - 1)) != 0
    return out.view(np.int64), null


def layout_of(vocabulary: str) -> Layout:
    """Narrow words where every id of a ranks file is below the narrow separator."""
    with open(vocabulary, "rb") as f:
        return NARROW if max(int(line.split()[1]) for line in f if line.strip()) < NARROW.separator else WIDE


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = VOCABULARY) -> None:
    """Tokenise every text into flat token files under ``path``, in the vocabulary's layout."""
    layout = layout_of(vocabulary)
    with open(vocabulary, "rb") as f:  # on the driver; workers get the content
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        encoder = tokenizer(ranks.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [np.append(encode(encoder, t.as_py() or ""), id_words(i, layout)).astype(layout.kind).tobytes()
                    for i, t in zip(ids, batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["tokens"])

    (docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(work, "tokens binary")
     .select(F.col("tokens").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", DOCS_PER_FILE).text(path, lineSep=layout.text))


def scan_token_files(spark: SparkSession, path: str, layout: Layout = NARROW, ids: bool = True,
                     block: int = BLOCK) -> DataFrame:
    """(path, document, start, n_tokens, id): documents of flat token files, numbered within a file.

    start is the place of a document's first token. Without ``ids`` the files hold tokens and
    separators only, and id is null."""
    trailer, word = layout.id_words if ids else 0, layout.size
    size = word * block
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
             .load(path).where("length > 0"))
    blocks = files.select("path", F.explode(F.expr(
        f"transform(sequence(0, cast((length - 1) div {size} as int)), b -> struct(b as block, substring(content, "
        f"greatest(b * {size} - {word * trailer}, 0) + 1, {size} + if(b = 0, 0, {word * trailer})) as words))")).alias("b"))

    def find(batches):
        for batch in batches:
            ends, keys = [], []
            for b, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(raw.as_buffer(), layout.kind)
                lead = trailer if b else 0
                at = np.flatnonzero(x[lead:] == layout.separator) + lead
                ends.append(at - lead + b * block)
                if trailer:
                    key, null = word_ids(np.stack([x[at - trailer + j] for j in range(trailer)], axis=1), layout)
                    keys.append(pa.array(key, mask=null))
                else:
                    keys.append(pa.nulls(len(at), pa.int64()))
            offs = np.concatenate(([0], np.cumsum([len(e) for e in ends]))).astype(np.int32)
            flat = np.concatenate(ends).astype(np.int64) if ends else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offs, pa.array(flat)),
                 pa.ListArray.from_arrays(offs, pa.concat_arrays(keys) if keys else pa.array([], pa.int64()))],
                ["path", "block", "ends", "ids"])

    found = blocks.select("path", "b.block", "b.words").mapInArrow(
        find, "path string, block int, ends array<bigint>, ids array<bigint>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (found
                .withColumn("carry", F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).over(before),
                                                F.lit(-1).cast("bigint")))
                .withColumn("nth", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return (stitched.select("path", "carry", "nth", "ends", "ids", F.posexplode("ends").alias("i", "e"))
            .select("path", (F.col("nth") + F.col("i")).alias("document"), start.alias("start"),
                    (F.col("e") - start - trailer).alias("n_tokens"), F.get("ids", F.col("i")).alias("id")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row, by way of token files in the shared scratch folder or ``path``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, id_col, text_col, vocabulary)
    return scan_token_files(spark, path, layout_of(vocabulary)).select(F.col("id").alias(id_col), "n_tokens")
