"""Substring deduplication by sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?`` (closing quotes and brackets aside),
and at a line break. A sentence of more than ``LONG`` words is cut further after every word whose
hash is divisible by 4, so that a passage without full stops, or one glued into another sentence,
is cut alike wherever it stands; what is still longer is cut every ``LONG`` words. From every
sentence, and back from every sentence, the shortest run of at least ``RUN`` consecutive sentences
with at least ``MIN_WORDS`` words is hashed over its words (A-Z lowered), so short lines make longer
runs. Where a passage is glued into other sentences its first and last one differ, so runs of more
than ``LONG`` words between content-defined cuts of the whole text, whatever its sentences, are hashed
as well. A run that occurs again, in any text, is removed everywhere but at its first place (smallest
id, then place): words go when any run that covers them isn't the first of its kind, and
``n_removed`` counts the sentences that lose any.

Two passes over the texts: the first counts run hashes (partial sums before the shuffle, so a
run in a third of the texts is a few rows); the second emits the places of repeated runs only,
found by a fixed-size bit filter, and ranks those of each run. The places of the most frequent runs are
one row a text and never ranked: the runs' first places, one a run, are broadcast to them. What a text loses is gathered by id and joined to the texts that may lose anything; the others aren't shuffled.

Nulls and ties: a null text stays null and an empty one empty, with no sentences; a row without an id
keeps its text and its runs don't count; repeated rows (same id and text) are one document, each
returned, and different texts under one id are different documents, told apart by 64 bits of a hash; equal runs in one text count like runs in two; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import POWERS, key_filter, mix64, parted, passes, schema_with, stored, text_words

RUN, MIN_WORDS, LONG = 3, 8, 16
RUNS_PER_BATCH = 1 << 18
HOT_SHARE = 4096
ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True
CLOSING = np.zeros(256, bool)
CLOSING[[34, 39, 41, 93]] = True


def sentences(data: np.ndarray, breaks: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              hashes: np.ndarray) -> np.ndarray:
    """Number of each sentence's first word, for one text's words; breaks are the line ends in data."""
    n = len(starts)
    if not n:
        return np.empty(0, np.int64)
    last = ends - 1
    for _ in range(2):
        last = np.where(CLOSING[data[last]] & (last > starts), last - 1, last)
    stop = ENDS[data[last]]
    stop[:-1] |= np.searchsorted(breaks, starts[1:]) > np.searchsorted(breaks, ends[:-1])
    first = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))
    size = np.diff(np.append(first, n))
    cut = np.repeat(size > LONG, size) & (hashes % np.uint64(4) == 0)
    cut[-1] = False
    return capped(np.union1d(first, np.flatnonzero(cut) + 1), n)


def capped(units: np.ndarray, n: int) -> np.ndarray:
    """The units' first words, units of more than LONG of the n words cut every LONG words."""
    more = (np.diff(np.append(units, n)) - 1) // LONG
    if not more.any():
        return units
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.union1d(units, np.repeat(units, more) + LONG * nth)


def passages(hashes: np.ndarray) -> np.ndarray:
    """Number of each piece's first word where a text is cut by content alone."""
    cut = np.flatnonzero(hashes[:-1] % np.uint64(4) == 0) + 1
    return capped(np.concatenate(([0], cut)), len(hashes))


def shortest_runs(units: np.ndarray, n: int, run: int, min_words: int, both: bool) -> np.ndarray:
    """First word and the word after the last, in one integer, of the shortest runs of at least ``run``
    units and ``min_words`` words from every unit on; with ``both`` also of those up to every unit."""
    edges, k = np.append(units, n), len(units)
    if k < run or n < min_words:
        return np.empty(0, np.int64)
    at = np.arange(k)
    to = np.maximum(at + run, np.searchsorted(edges, edges[:-1] + min_words))
    if not both:
        return edges[at[to <= k]] << 32 | edges[to[to <= k]]
    end = np.arange(1, k + 1)
    back = np.minimum(end - run, np.searchsorted(edges, edges[1:] - min_words, side="right") - 1)
    a = np.concatenate((at[to <= k], back[back >= 0]))
    b = np.concatenate((to[to <= k], end[back >= 0]))
    return np.unique(edges[a] << 32 | edges[b])


def row_units(col: pa.Array):
    """(row, word begin places, word hash sums, powers, first word of each sentence, word hashes) of every
    text. Places are bytes, the first word's being the text's own begin."""
    for first, data, s, e, h, counts in text_words(col):
        # Hash of any word range from prefix sums, as for words.
        up, down = POWERS.upto(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=sums[1:])
        breaks, at = np.flatnonzero(data == 10), 0
        for i, n in enumerate(counts.tolist()):
            own = slice(at, at + n)
            units = sentences(data, breaks, s[own], e[own], h[own])
            yield first + i, s[own], sums[at:at + n + 1], down[own], units, h[own]
            at += n


def row_runs(col: pa.Array, run: int, min_words: int):
    """(row, run hashes, first word and number of words of each run) of every text.

    The latter two share an integer; first and last would collide in the JVM's hash of a long."""
    for row, _, sums, down, units, h in row_units(col):
        n = len(h)
        if not n:
            continue
        spans = np.union1d(shortest_runs(units, n, run, min_words, True),
                           shortest_runs(passages(h), n, run, max(min_words, LONG + 1), False))
        a, b = spans >> 32, spans & 0xFFFFFFFF
        yield row, mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64), a << 32 | b - a


def version(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, run: int, min_words: int) -> DataFrame:
    """(id, x, drop): the runs each text loses, in order; x tells apart texts under one id."""
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), version(F.col(text_col)).alias("x"), F.col(text_col).alias("text"))

    def hashes(batches):
        for batch in batches:
            keys, held = [], 0
            for _, k, _ in row_runs(batch.column(0), run, min_words):
                keys.append(k)
                held += len(k)
                if held >= RUNS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["h"])
                    keys, held = [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["h"])

    again = stored(texts.select("text").mapInArrow(hashes, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                   .where("n > 1"), "runs-repeated")
    keep = docs.sparkSession.sparkContext.broadcast(key_filter(again, F.col("h")))

    # The runs with more than one in HOT_SHARE of all places are fewer than HOT_SHARE by that.
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(
        [r["h"] for r in again.where(F.col("n") * HOT_SHARE > total).select("h").collect()], np.int64)))

    def emit(batches):
        def made(batch, rows, keys, places):
            row, k, at = np.concatenate(rows), np.concatenate(keys), np.concatenate(places)
            often = np.isin(k, hot.value)
            alone, own = pa.array(row[~often]), row[often]
            texts = np.unique(own)
            edges = pa.array(np.append(np.searchsorted(own, texts), len(own)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(v[often])) for v in (k, at)]
            for take, columns in ((alone, [pa.array(k[~often]), pa.array(at[~often]), *[pa.nulls(len(alone), c.type) for c in lists]]),
                                  (pa.array(texts), [*[pa.nulls(len(texts), pa.int64())] * 2, *lists])):
                if len(take):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns],
                                                     ["id", "x", "h", "at", "hs", "ats"])

        for batch in batches:
            rows, keys, places, held = [], [], [], 0
            for row, k, at in row_runs(batch.column(2), run, min_words):
                if len(k):
                    ok = passes(keep.value, k)
                    k, at = k[ok], at[ok]
                rows.append(np.full(len(k), row))
                keys.append(k)
                places.append(at)
                held += len(k)
                if held >= RUNS_PER_BATCH:
                    yield from made(batch, rows, keys, places)
                    rows, keys, places, held = [], [], [], 0
            if rows:
                yield from made(batch, rows, keys, places)

    # A place that only passes the filter is the first of its run and goes no further.
    places = stored(texts.mapInArrow(emit, "id bigint, x bigint, h bigint, at bigint, hs array<bigint>, ats array<bigint>"),
                    "runs-places")
    # No run left here is a hot key. Places of repeated rows are equal and share their rank.
    nth = F.rank().over(Window.partitionBy("h").orderBy("id", "x", "at"))
    seldom = (places.where("h IS NOT NULL").select("h", "id", "x", "at", nth.alias("nth")).where("nth > 1")
              .groupBy("id", "x").agg(F.collect_set("at").alias("drop")))
    often = later_places(places.where("hs IS NOT NULL").select("id", "x", "hs", "ats"))
    # Only the runs of one text meet here.
    return (seldom.unionByName(often).groupBy("id", "x")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("drop")))).alias("drop")))


def later_places(texts: DataFrame) -> DataFrame:
    """(id, x, drop): the places of each text that aren't the first of their run. ``texts`` has the hashes and places of a
    text's runs as two arrays, of fewer different hashes than a task and the driver can hold."""
    def flat(batch):
        sizes = batch.column(2).value_lengths().to_numpy()
        row = np.repeat(np.arange(len(batch)), sizes)
        ids, x = (batch.column(i).to_numpy()[row] for i in (0, 1))
        return row, batch.column(2).flatten().to_numpy(), ids, x, batch.column(3).flatten().to_numpy()

    def least(batches):
        best = [np.empty(0, np.int64)] * 4
        for batch in batches:
            h, ids, x, at = (np.concatenate(c) for c in zip(best, flat(batch)[1:]))
            order = np.lexsort((at, x, ids, h))
            order = order[np.diff(h[order], prepend=h[order][:1] - 1) != 0]
            best = [c[order] for c in (h, ids, x, at)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["h", "id", "x", "at"])

    firsts = (texts.mapInArrow(least, "h bigint, id bigint, x bigint, at bigint")
              .groupBy("h").agg(F.min(F.struct("id", "x", "at")).alias("f")).select("h", "f.*").orderBy("h").collect())
    shared = texts.sparkSession.sparkContext.broadcast(np.array(firsts, np.int64).reshape(-1, 4))

    def later(batches):
        first = shared.value
        for batch in batches:
            row, h, ids, x, at = flat(batch)
            own = first[np.searchsorted(first[:, 0], h)]
            drop = (own[:, 1] != ids) | (own[:, 2] != x) | (own[:, 3] != at)
            losing, counts = np.unique(row[drop], return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(at[drop]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(losing)) for i in (0, 1)), lists], ["id", "x", "drop"])

    return texts.mapInArrow(later, "id bigint, x bigint, drop array<bigint>")


def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
                          min_words: int = MIN_WORDS) -> DataFrame:
    """docs with cleaned texts and (n_sentences, n_removed, removed), removed being ``start:end`` spans
    of the original text in code points, joined by commas."""
    added = ["n_sentences", "n_removed", "removed"]
    others = [c for c in docs.columns if c not in (text_col, *added)]
    lost = stored(repeated_runs(docs, id_col, text_col, run, min_words), "runs-lost")
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).alias("__text"))
    lost = lost.select(F.col("id").alias("__id"), F.col("x").alias("__x"), F.col("drop").alias("__drop"))
    affected, whole = parted(rows, id_col, lost, "__id")
    affected = (affected.join(lost, (F.col(f"`{id_col}`") == F.col("__id")) & (version(F.col("__text")) == F.col("__x")), "left")
                .drop("__id", "__x"))
    rows = affected.unionByName(whole.withColumn("__drop", F.lit(None).cast("array<bigint>")))

    def clean(batches):
        for batch in batches:
            col, drops = batch.column("__text"), batch.column("__drop")
            texts, counts, gone, spans = [], [], [], []
            for i, begins, _, _, units, _ in row_units(col):
                drop = drops[i].values.to_numpy() if drops[i].is_valid else ()
                counts.append(len(units))
                if not len(drop):
                    gone.append(0)
                    texts.append(col[i].as_py())
                    spans.append("")
                    continue
                whole = col[i].as_py().encode()
                # begins are places in the slice's bytes: the text's own begin is found from its end
                base = begins - begins[0] + (len(whole) - len(whole.lstrip(b" \t\n\x0b\x0c\r")))
                edges = np.append(base, len(whole))
                change = np.zeros(len(begins) + 1, np.int64)
                np.add.at(change, drop >> 32, 1)
                np.add.at(change, (drop >> 32) + (drop & 0xFFFFFFFF), -1)
                keep = np.cumsum(change[:-1]) == 0
                gone.append(int((np.add.reduceat(~keep, units) > 0).sum()))
                edge = np.flatnonzero(np.diff(np.concatenate(([1], keep, [1])).astype(np.int8)))
                out, at, said, chars = [], 0, [], 0
                for a, b in edge.reshape(-1, 2):
                    out.append(whole[at:edges[a]])
                    begin = chars + len(out[-1].decode())
                    chars = begin + len(whole[edges[a]:edges[b]].decode())
                    said.append(f"{begin}:{chars}")
                    at = edges[b]
                texts.append((b"".join(out) + whole[at:]).decode())
                spans.append(",".join(said))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(spans, pa.string())], [*others, text_col, *added])

    return rows.mapInArrow(clean, schema_with(
        docs, others, f"`{text_col}` string, n_sentences bigint, n_removed bigint, removed string"))
