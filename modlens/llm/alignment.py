"""Cross-tokenizer alignment: A and B token ends merged in lockstep, all lanes of a batch at once.

Tokens. A is a byte-level BPE (``tokenizers`` file) of a blank and the text, B a piece BPE (``sentencepiece``
model) of the text, which puts the blank there itself. Special tokens' strings in a text are plain text.
A's token bytes are its byte-level decoded string, B's are its piece with U+2581 as a blank and ``<0xHH>``
as a byte. A text has no tokens if it is null or empty or if either side's joined bytes aren't the blank
and the text (U+2581 in a text, for one).

Lanes. Neither tokenizer joins a blank to what stands before it: A's pattern only takes a blank in front of a
word, and no B piece holds U+2581 behind another character. So a text may be cut in front of any single blank
between two characters that aren't white space, and each part encoded alone gives the text's own tokens.
Parts of about ``LANE`` characters are the merge's lanes: a long text is many short lanes, no slower
than many texts. A stretch without such a blank is one lane, however long.

Lockstep merge. One state vector holds each lane's place in A and in B. A step compares the two ends of all
lanes, emits a link and a cut where they are equal, moves A where its end comes first or both are equal,
and B likewise; finished lanes are compacted away. A link is an A and a B token that end together; the cuts
divide both sides into groups.

Corpus counts. An id pair's count is its number of links in the corpus. Tasks send each document's distinct
pairs with their multiplicity, Spark sums them. The most frequent pairs, at most ``HEAD`` and found from a
histogram of counts, go back to the tasks as sorted arrays (13 MB at most); the rest, each under one
``HEAD``-th of all links, meet the documents that hold them in a shuffle join, so no key is hot. Results
don't depend on ``HEAD``.

Nulls and ties: see above for null and empty texts, whose counts are 0 and digest is ''; a null id is kept;
repeated rows are documents of their own and count as often; pairs that tie for a B id's highest count are
all best; an empty table gives none. Only the id and text columns are read, so other columns have no part.
The vocabulary files are read on the driver and shipped, so executors need no copy. Memory of a task: lanes
are encoded in chunks of ``CHUNK`` characters; a long text adds its distinct pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm.common import stored, workers_find_package

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
LANE = 1000
CHUNK = 1 << 18
HEAD = 1 << 20


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        begin = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.at[ids] - begin, sizes) + np.arange(int(sizes.sum()))]


class Tokenizers:
    """Both tokenizers and their vocabularies."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = byte_of_char()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_vocab = Vocabulary([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                                   for t in (names.get(i, "") for i in range(max(names) + 1))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_vocab = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                   for i, p in enumerate(pieces)])
        parts = [f"{i},".encode() for i in range(len(self.a_vocab))] + [f"{i}|".encode() for i in range(len(self.a_vocab))]
        parts += [f"{i},".encode() for i in range(len(self.b_vocab))] + [f"{i};".encode() for i in range(len(self.b_vocab))]
        self.written = np.array(parts, object)  # what an id adds to a document's groups

    def encode(self, lanes: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast([" " + t for t in lanes], add_special_tokens=False)]
        b = [np.array(x, np.int32) for x in self.b.encode(lanes, num_threads=1)]
        return a, b


@lru_cache(maxsize=1)
def tokenizers(a_file: bytes, b_file: bytes) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def lanes_of(text: str, size: int = LANE) -> list[str]:
    """Parts of a text; the blank in front of each but the first is dropped, as encoding adds it."""
    out, a = [], 0
    at = text.find(" ", size)
    while at >= 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(text[a:at])
            a = at + 1
            at = text.find(" ", a + size)
        else:
            at = text.find(" ", at + 1)
    out.append(text[a:])
    return out


def offsets(parts: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0] + [len(p) for p in parts])


def lane_ends(vocab: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes from its lane's begin."""
    total = np.concatenate(([0], np.cumsum(vocab.sizes[ids])))
    return total[1:] - np.repeat(total[offs[:-1]], np.diff(offs))


def whole_lanes(vocab: Vocabulary, ids: np.ndarray, offs: np.ndarray, ends: np.ndarray, lanes: list[bytes]) -> np.ndarray:
    """Whether each lane's joined token bytes are the lane's own."""
    some = np.diff(offs) > 0
    size = np.zeros(len(lanes), np.int64)
    size[some] = ends[offs[1:][some] - 1]
    good = size == np.array([len(x) for x in lanes], np.int64)
    taken = np.flatnonzero(good)
    want = np.frombuffer(b"".join(lanes[i] for i in taken), np.uint8)
    differ = vocab.bytes_of(ids[np.repeat(good, np.diff(offs))]) != want
    if differ.any():
        begins = np.cumsum(size[taken]) - size[taken]
        good[taken[np.unique(np.searchsorted(begins, np.flatnonzero(differ), side="right") - 1)]] = False
    return good


def lockstep(a_ends: np.ndarray, a_offs: np.ndarray, b_ends: np.ndarray, b_offs: np.ndarray,
             good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) that end together, in order, of the good lanes. Both sides of a good lane hold
    the same bytes, so both end with a cut and finish in the same step."""
    i, j, stop = a_offs[:-1][good], b_offs[:-1][good], a_offs[1:][good]
    links: list[tuple[np.ndarray, np.ndarray]] = [(i[:0], j[:0])]
    while len(i):
        x, y = a_ends[i], b_ends[j]
        cut = x == y
        links.append((i[cut], j[cut]))
        i, j = i + (x <= y), j + (y <= x)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return tuple(np.sort(np.concatenate(side)) for side in zip(*links))


class Chunk:
    """Some lanes, encoded and merged: ids of both sides, lane offsets, which lanes are good, and the links
    as token places in the chunk."""

    def __init__(self, t: Tokenizers, lanes: list[str]):
        a, b = t.encode(lanes)
        self.a_offs, self.b_offs = offsets(a), offsets(b)
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        raw = [b" " + x.encode() for x in lanes]
        a_ends, b_ends = lane_ends(t.a_vocab, self.a, self.a_offs), lane_ends(t.b_vocab, self.b, self.b_offs)
        self.good = (whole_lanes(t.a_vocab, self.a, self.a_offs, a_ends, raw)
                     & whole_lanes(t.b_vocab, self.b, self.b_offs, b_ends, raw))
        if not self.good.all():  # bad lanes keep no tokens
            (self.a, a_ends, self.a_offs), (self.b, b_ends, self.b_offs) = (
                (ids[held], ends[held], np.concatenate(([0], np.cumsum(np.diff(offs) * self.good))))
                for ids, ends, offs in ((self.a, a_ends, self.a_offs), (self.b, b_ends, self.b_offs))
                for held in [np.repeat(self.good, np.diff(offs))])
        self.i, self.j = lockstep(a_ends, self.a_offs, b_ends, self.b_offs, self.good)

    def written(self, t: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that each token adds to the groups, lane offsets): the A tokens of a group, then its B tokens."""
        n, m, na = len(self.a), len(self.b), len(t.a_vocab)
        a_group, b_group = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
        a_group[self.i + 1] = b_group[self.j + 1] = 1
        a_group, b_group = np.cumsum(a_group[:-1]), np.cumsum(b_group[:-1])  # groups closed before each token
        a_upto, b_upto = np.concatenate(([0], self.i + 1, [n])), np.concatenate(([0], self.j + 1, [m]))
        codes = np.empty(n + m, np.int64)
        last_a, last_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        last_a[self.i] = last_b[self.j] = 1
        codes[np.arange(n) + b_upto[a_group]] = self.a + last_a * na
        codes[np.arange(m) + a_upto[b_group + 1]] = 2 * na + self.b + last_b * len(t.b_vocab)
        return t.written[codes], self.a_offs + self.b_offs


def chunks(t: Tokenizers, texts: list[str], lane: int, chunk: int) -> Iterator[tuple[np.ndarray, Chunk]]:
    """(each lane's text, the lanes encoded and merged), texts in order; a long text spans several."""
    held, of, size = [], [], 0
    for k, text in enumerate(texts):
        for part in lanes_of(text, lane) if text else ():
            held.append(part)
            of.append(k)
            size += len(part)
            if size >= chunk:
                yield np.array(of), Chunk(t, held)
                held, of, size = [], [], 0
    if held:
        yield np.array(of), Chunk(t, held)


class Summary:
    """Counts, pairs and group digests of a list of texts, gathered chunk by chunk."""

    def __init__(self, t: Tokenizers, texts: list[str], lane: int = LANE, chunk: int = CHUNK):
        n = len(texts)
        self.sizes = np.zeros((n, 3), np.int64)  # A tokens, B tokens, groups
        bad = np.zeros(n, bool)
        digests = [None] * n
        pairs = [[] for _ in range(n)]
        for of, c in chunks(t, texts, lane, chunk):
            bad[of[~c.good]] = True
            np.add.at(self.sizes[:, 0], of, np.diff(c.a_offs))
            np.add.at(self.sizes[:, 1], of, np.diff(c.b_offs))
            doc = of[np.searchsorted(c.a_offs, c.i, side="right") - 1]
            np.add.at(self.sizes[:, 2], doc, 1)
            code = c.a[c.i].astype(np.int64) * len(t.b_vocab) + c.b[c.j]
            span = len(t.a_vocab) * len(t.b_vocab)
            both, times = np.unique(doc * span + code, return_counts=True)
            parts, offs = c.written(t)
            first, at = np.unique(of, return_index=True)
            begins, ends = offs[at], np.append(offs[at[1:]], offs[-1])
            cuts = np.searchsorted(both, np.append(first, n) * span)
            for k, s, e, p, q in zip(first.tolist(), begins.tolist(), ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                if bad[k]:
                    continue
                own = b"".join(parts[s:e])[:-1]
                if digests[k] is None:
                    digests[k] = hashlib.sha256(own)
                else:
                    digests[k].update(b";" + own)
                pairs[k].append((both[p:q] - k * span, times[p:q]))
        self.sizes[bad] = 0
        self.digests = ["" if b or d is None else d.hexdigest() for b, d in zip(bad, digests)]
        self.pairs = [merged([] if b else p) for b, p in zip(bad, pairs)]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, times) of several such lists."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets(parts), pa.int32()), pa.array(flat, kind))


def shipped(spark: SparkSession, *paths: str):
    """The files' bytes, read on the driver."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(f.read())
    return spark.sparkContext.broadcast(tuple(out))


def batches_of_texts(batches, most: int = CHUNK):
    """(ids, texts) in portions of about ``most`` characters; a null text is empty."""
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        a, size = 0, 0
        for b, text in enumerate(texts, 1):
            size += len(text)
            if size >= most or b == len(texts):
                yield batch.column(0).slice(a, b - a), texts[a:b]
                a, size = b, 0


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_FILE, b_path: str = B_FILE,
               lane: int = LANE) -> DataFrame:
    """(id, a_ids, b_ids, a_cuts, b_cuts): both token lists, and the number of A and of B tokens in front of each
    cut, so group g is ``a_ids[a_cuts[g - 1]:a_cuts[g]]`` beside ``b_ids[b_cuts[g - 1]:b_cuts[g]]``."""
    workers_find_package(docs.sparkSession)
    files = shipped(docs.sparkSession, a_path, b_path)

    def work(batches):
        t = tokenizers(*files.value)
        for ids, texts in batches_of_texts(batches):
            out = [([], [], [], []) for _ in texts]
            done = np.zeros((len(texts), 2), np.int64)
            bad = np.zeros(len(texts), bool)
            for of, c in chunks(t, texts, lane, CHUNK):
                bad[of[~c.good]] = True
                first, at = np.unique(of, return_index=True)
                for k, s, e in zip(first, at, np.append(at[1:], len(of))):
                    (a, b), (x, y) = (c.a_offs[s], c.a_offs[e]), (c.b_offs[s], c.b_offs[e])
                    own = slice(*np.searchsorted(c.i, (a, b)))
                    for held, new in zip(out[k], (c.a[a:b], c.b[x:y], c.i[own] - a + 1 + done[k, 0], c.j[own] - x + 1 + done[k, 1])):
                        held.append(new)
                    done[k] += (b - a, y - x)
            columns = [[np.concatenate(o[f]) if o[f] and not z else np.empty(0, np.int64) for o, z in zip(out, bad)] for f in range(4)]
            yield pa.RecordBatch.from_arrays([ids, *(lists(col, pa.int32()) for col in columns)],
                                             ["id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, a_ids array<int>, b_ids array<int>, "
                                  "a_cuts array<int>, b_cuts array<int>").withColumnRenamed("id", id_col))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_FILE, b_path: str = B_FILE,
                lane: int = LANE, head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row: the alignment's
    sizes, its links' corpus-wide counts, and the sha256 of its groups written ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    workers_find_package(spark)
    files = shipped(spark, a_path, b_path)
    here = tokenizers(*files.value)
    n_b, codes = len(here.b_vocab), len(here.a_vocab) * len(here.b_vocab)
    code, wide = ("int", pa.int32()) if codes < 1 << 31 else ("bigint", pa.int64())

    def work(batches):
        t = tokenizers(*files.value)
        for ids, texts in batches_of_texts(batches):
            s = Summary(t, texts, lane)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(s.sizes[:, i]) for i in range(3)), pa.array(s.digests, pa.string()),
                 lists([p[0] for p in s.pairs], wide), lists([p[1] for p in s.pairs], pa.int32())],
                ["id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["id"]
    summed = stored(rows.mapInArrow(work, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
                                          f"codes array<{code}>, times array<int>")
                    .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = (summed.select(F.inline(F.arrays_zip("codes", "times"))).groupBy(F.col("codes").alias("code"))
              .agg(F.sum("times").alias("n")))
    counts = stored(counts, "pair-counts")
    b_id = F.col("code") % n_b
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    ranked = stored(counts.join(best, b_id == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("top")),
                    "pair-ranks")
    least = frequent_from(ranked, head)
    frequent = ranked.where(F.col("n") >= least).orderBy("code").toPandas()
    shared = spark.sparkContext.broadcast((frequent["code"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64),
                                           frequent["top"].to_numpy(bool)))

    def resolve(batches):
        known, n, top = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            *kept, codes, times = batch.columns
            of = np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy(zero_copy_only=False))
            held, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (codes, times))
            at = np.minimum(np.searchsorted(known, held), max(len(known) - 1, 0))
            found = known[at] == held if len(known) else np.zeros(len(held), bool)
            total, most = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[found], times[found] * n[at[found]])
            np.add.at(most, of[found], times[found] * top[at[found]])
            rest = np.concatenate(([0], np.cumsum(np.bincount(of[~found], minlength=batch.num_rows))))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(most), pa.array(total),
                 *(pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~found], k))
                   for x, k in ((held, wide), (times, pa.int32())))],
                [*own, "n_best", "count_sum", "codes", "times"])

    own = ["id", "row", "n_a", "n_b", "n_groups", "groups_sha256"]
    scored = summed.select(*own, "codes", "times").mapInArrow(
        resolve, f"id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, "
                 f"count_sum bigint, codes array<{code}>, times array<int>")
    if least > 1:
        scored = stored(scored, "pair-rest")
        rare = ranked.where(F.col("n") < least)
        more = (scored.select("row", F.inline(F.arrays_zip("codes", "times"))).withColumnRenamed("codes", "code").join(rare, "code")
                .groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rest_sum"),
                                    F.sum(F.col("times") * F.col("top").cast("int")).alias("rest_best")))
        scored = (scored.join(more, "row", "left")
                  .select(*own, (F.col("n_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
                          (F.col("count_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum")))
    return scored.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        "n_best", "count_sum", "groups_sha256")


def frequent_from(ranked: DataFrame, head: int) -> int:
    """The least power of two that at most ``head`` pairs reach, from a histogram of at most 63 rows."""
    bits = F.length(F.bin("n"))
    total = 0
    for r in sorted(ranked.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True):
        total += r["pairs"]
        if total > head:
            return 1 << r["bits"]
    return 1
