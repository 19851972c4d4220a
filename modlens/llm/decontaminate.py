"""Benchmark decontamination: regions of a text that equal a benchmark passage up to a few edits.

Texts and benchmark items are folded alike: A-Z lowered; each run of bytes other than letters,
digits and non-ASCII is one blank. An item's windows are its ``WINDOW`` folded bytes at every
offset (the whole item if it is shorter); those at every ``STRIDE`` are tried first, the others where none of
them aligns. A text is contaminated by an item where a region of it aligns with one of the windows
within ``EDITS`` percent of the window's length. Items that fold to fewer than ``MIN_ITEM`` bytes are found
without edits, between word edges, and below ``EDGE_ITEM`` bytes as whole texts only, as a word isn't a leak.

Q-gram lemma: a region within k edits of a window of n bytes shares at least n - q + 1 - k q of its
q-grams, on diagonals (place in text less place in benchmark) that differ by at most k. Every
8-gram of a text is looked up exactly (as a 64-bit value, after a bit filter); hits are counted in
cells of 16 diagonals per item, and two neighbouring cells make a band, so bands overlap by half
and one holds the whole alignment. Windows with enough hits in a band are verified by a banded
alignment with free ends in the text, for all candidates of a slice at once.

The benchmark is the stated query set. It is taken in blocks of at most ``BLOCK_BYTES`` folded bytes
(one pass over the texts each), so what is broadcast is bounded. Whole texts are read, in slices; a
very long text is searched in pieces that overlap by more than an alignment's length. Nothing is
shuffled but the results.

Nulls and ties: null and empty texts have no regions; items that are null or fold to nothing are in no
text; an item with a null id is searched like any; items with equal texts are each reported; repeated rows are each reported; empty tables on either side give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import SLICE_BYTES, slices, utf8

Q, WINDOW, STRIDE, EDITS, MIN_ITEM, EDGE_ITEM = 8, 80, 16, 10, 24, 12
CELL = 16
FILTER = 20
BLOCK_BYTES = 8 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)

#: Between two texts of a slice: more bytes than an alignment may skip.
GAP = WINDOW * EDITS // 100 + 1


def fold(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes of all rows with GAP zeros after each, place in data of each byte; -1 in gaps)."""
    x = FOLD[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[offs[:-1][offs[:-1] < len(x)]] = True
    src = np.flatnonzero(keep)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(src, offs)))
    at = np.arange(len(src)) + row * GAP
    out = np.zeros(len(src) + GAP * (len(offs) - 1), np.uint8)
    origin = np.full(len(out), -1, np.int64)
    out[at], origin[at] = x[src], src
    return out, origin


def qgrams(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one integer."""
    if len(x) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(x) - Q + 1,), "<u8", np.ascontiguousarray(x).tobytes(), strides=(1,)).copy()


class Benchmark:
    """Index of a block of items: their q-grams with places, and their windows."""

    def __init__(self, items: list[tuple[int, bytes]]):
        sized = [(i, t, fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][:-GAP]) for i, t in items]
        self.short: dict[str, list[int]] = {}
        items = [(i, t) for i, t, f in sized if len(f) >= MIN_ITEM]
        little = [(i, f.tobytes().strip(b" ").decode("latin-1")) for i, _, f in sized if len(f) < MIN_ITEM]
        self.ids = [i for i, _ in items] + [i for i, _ in little]
        for n, (_, needle) in enumerate(little, len(items)):
            if needle:
                self.short.setdefault(needle, []).append(n)
        folded = [fold(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][:-GAP] for _, t in items]
        self.sizes = sizes = np.array([len(f) for f in folded], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes + GAP)))
        self.text = np.zeros(self.begin[-1], np.uint8)
        self.owner = np.repeat(np.arange(len(sizes)), sizes + GAP)  # item of each place
        self.units: list[np.ndarray] = []
        self.length = np.minimum(sizes, WINDOW)
        for f, b, n in zip(folded, self.begin, self.length):
            self.text[b:b + len(f)] = f
            starts = list(range(0, len(f) - n + 1, STRIDE))
            if starts[-1] != len(f) - n:
                starts.append(len(f) - n)
            self.units.append(b + np.array(starts))
        self.edits = self.length * EDITS // 100
        self.least = np.maximum(self.length - Q + 1 - self.edits * Q, 1)
        grams, places = [], []
        for b, n in zip(self.begin, sizes):
            g = qgrams(self.text[b:b + n])
            grams.append(g)
            places.append(b + np.arange(len(g)))
        grams = np.concatenate([np.empty(0, np.uint64), *grams])
        places = np.concatenate([np.empty(0, np.int64), *places])
        order = np.argsort(grams, kind="stable")
        self.place = places[order]
        self.gram, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER, bool)
        self.filter[(self.gram * MULT) >> np.uint64(64 - FILTER)] = True


    def automaton(self):
        """The short items' matcher, made once per process."""
        if not hasattr(self, "_automaton"):
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for needle, items in self.short.items():
                self._automaton.add_word(needle, (needle, items))
            self._automaton.make_automaton()
        return self._automaton


def hits(b: Benchmark, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in text, place in benchmark) of every shared q-gram."""
    g = qgrams(x)
    if not len(b.gram):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(b.filter[(g * MULT) >> np.uint64(64 - FILTER)])
    k = np.minimum(np.searchsorted(b.gram, g[at]), len(b.gram) - 1)
    same = b.gram[k] == g[at]
    at, k = at[same], k[same]
    n = b.count[k]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), b.place[np.repeat(b.first[k], n) + within]


def candidates(b: Benchmark, x: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]]]:
    """(item, window's place, first diagonal of the band) of the windows at every ``STRIDE`` with enough shared
    q-grams, and (item, diagonal, shared places) of every band where some window has enough."""
    p, g = hits(b, x)
    if not len(p):
        return [], []
    n_items = len(b.sizes)
    key = ((p - g + len(b.text)) // CELL) * n_items + b.owner[g]
    order = np.argsort(key)  # any order within a cell: places are sorted where they are used
    key, g = key[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    cells, count = key[first], np.diff(np.append(first, len(key)))
    # A band is a cell and the next one. One of the two holds at least half of what a band must hold.
    strong = cells[2 * count >= b.least[cells % n_items]]
    bands = np.sort(np.concatenate((strong, strong - n_items)))
    bands = bands[np.concatenate(([True], bands[1:] != bands[:-1]))] if len(bands) else bands
    size = np.zeros(len(bands), np.int64)
    for shift in (0, n_items):
        k = np.minimum(np.searchsorted(cells, bands + shift), len(cells) - 1)
        size += np.where(cells[k] == bands + shift, count[k], 0)
    # The distinct benchmark places of each band that has enough hits, bands one after the other.
    bands = bands[size >= b.least[bands % n_items]]
    held = []
    for shift in (0, n_items):
        k = np.minimum(np.searchsorted(cells, bands + shift), len(cells) - 1)
        n = np.where(cells[k] == bands + shift, count[k], 0)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held.append((np.repeat(np.arange(len(bands)), n) << 32) | g[np.repeat(first[k], n) + within])
    held = np.sort(np.concatenate(held))
    held = held[np.concatenate(([True], held[1:] != held[:-1]))] if len(held) else held
    of, places = held >> 32, held & 0xFFFFFFFF
    # A window's worth of them must stand within a window's length.
    i = bands[of] % n_items
    last = np.arange(len(held)) + b.least[i] - 1
    inside = last < len(held)
    last = np.where(inside, last, 0)
    dense = inside & (of[last] == of) & (places[last] - places <= b.length[i] - Q)
    out, bands_with_enough = [], []
    for k in np.unique(of[dense]).tolist():
        band = int(bands[k])
        i = band % n_items
        own = places[np.searchsorted(of, k):np.searchsorted(of, k + 1)]
        diagonal = band // n_items * CELL - len(b.text)
        out.extend((i, u, diagonal) for u in enough(b, i, b.units[i], own))
        bands_with_enough.append((i, diagonal, own))
    return out, bands_with_enough


def enough(b: Benchmark, i: int, units: np.ndarray, own: np.ndarray) -> list[int]:
    """Those of an item's windows that hold enough of the shared places."""
    shared = np.searchsorted(own, units + b.length[i] - Q + 1) - np.searchsorted(own, units)
    return units[shared >= b.least[i]].tolist()


def align(b: Benchmark, x: np.ndarray, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, window, edits, start, end in x) of the candidates that align within their budget.

    Cell (i, j) pairs the window's first i bytes with the text up to diagonal j of the band; cost
    and start share one integer, so that the least cost brings its start along."""
    item = np.array([f[0] for f in found])
    for n in np.unique(b.length[item]).tolist():
        for part in np.array_split(np.flatnonzero(b.length[item] == n), max(1, (b.length[item] == n).sum() // 4096)):
            k = n * EDITS // 100
            wide = 2 * CELL + 2 * k
            unit = np.array([found[c][1] for c in part])
            left = unit + np.array([found[c][2] for c in part]) - k  # text place of column 0 in row 0
            edge = n + wide
            padded = np.concatenate((np.zeros(edge, np.uint8), x, np.zeros(edge, np.uint8)))
            columns = np.arange(wide)
            step = np.int64(1) << 32
            cost = np.broadcast_to(columns, (len(part), wide)).astype(np.int64)  # start column, no edits yet
            far = np.int64(n + 1) * step
            for i in range(n):
                place = np.clip(left[:, None] + columns + i + edge, 0, len(padded) - 1)
                differs = padded[place] != b.text[unit + i][:, None]
                skip = np.concatenate((cost[:, 1:], np.full((len(part), 1), far)), axis=1) + step
                cost = np.minimum(cost + differs * step, skip)
                cost = np.minimum.accumulate(cost - columns * step, axis=1) + columns * step
            best = cost.argmin(1)
            value = cost[np.arange(len(part)), best]
            for c, j, v, l in zip(part.tolist(), best.tolist(), value.tolist(), left.tolist()):
                if v >> 32 <= k:
                    yield found[c][0], found[c][1], v >> 32, max(l + (v & 0xFFFFFFFF), 0), min(l + j + n, len(x))


def search(b: Benchmark, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, window, edits, start, end); start and end are byte places in data."""
    x, origin = fold(data, offs)
    coarse, bands = candidates(b, x)
    found = set()

    def rows_of(s, e):
        place = origin[max(s, 0):max(e, 0)]
        place = place[place >= 0]
        return place, np.searchsorted(offs, place, side="right") - 1

    def placed(hits):
        for item, unit, edits, s, e in hits:
            place, rows = rows_of(s, e)
            if len(place):
                row = int(rows[len(rows) // 2])
                place = place[rows == row]
                found.add((row, item))
                yield row, item, unit, edits, int(place[0]), int(place[-1]) + 1

    if coarse:
        yield from placed(align(b, x, coarse))
    # A region may begin between two strides and have no edits to spare: where a band's texts aren't found yet,
    # windows at every offset are tried.
    fine = []
    for i, diagonal, own in bands:
        _, rows = rows_of(int(own[0]) + diagonal, int(own[-1]) + diagonal + 2 * CELL + Q)
        if any((r, i) not in found for r in np.unique(rows).tolist()):
            every = b.begin[i] + np.arange(b.sizes[i] - b.length[i] + 1)
            fine.extend((i, u, diagonal) for u in enough(b, i, every, own))
    if fine:
        yield from placed(align(b, x, fine))
    yield from short_items(b, x, origin, offs)


def short_items(b: Benchmark, x: np.ndarray, origin: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Items of fewer than ``MIN_ITEM`` folded bytes, found exactly: between word edges, or those of fewer
    than ``EDGE_ITEM`` as whole texts only."""
    if not b.short:
        return
    text = x.tobytes().decode("latin-1")
    for last, (needle, items) in b.automaton().iter(text):
        s, e = last + 1 - len(needle), last + 1
        if (s and x[s - 1] not in (0, 32)) or (e < len(x) and x[e] not in (0, 32)):
            continue
        row = int(np.searchsorted(offs, origin[s], side="right")) - 1
        if len(needle) < EDGE_ITEM:
            left, right = text[:s].rpartition("\0")[2], text[e:].partition("\0")[0]
            if left.strip(" ") or right.strip(" "):
                continue
        for item in items:
            yield row, item, -1, 0, int(origin[s]), int(origin[e - 1]) + 1


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, in order of id."""
    held, size = [], 0
    rows = (items.where(F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t"))
    for r in rows.toLocalIterator():
        t = r["t"].encode()
        held.append((r["i"], t))
        size += len(t)
        if size >= BLOCK_BYTES:
            yield Benchmark(held)
            held, size = [], 0
    if held:
        yield Benchmark(held)


def characters(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, edits, start, end): one row per text and item that share a region.

    n_windows counts the item's windows found, edits is the fewest of one, and start and end
    (code points) span the windows found."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` bigint, `{item_id}` bigint, n_windows bigint, edits bigint, start bigint, end bigint"
    names = [id_col, item_id, "n_windows", "edits", "start", "end"]
    overlap = 4 * (WINDOW + 2 * CELL)
    found = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches, shared=shared):
            b = shared.value
            for batch in batches:
                raw, offs = utf8(batch.column(1))
                merged: dict[tuple[int, int], list] = {}
                for first, last in slices(offs):
                    lo, hi = int(offs[first]), int(offs[last])
                    long = last == first + 1 and hi - lo > 2 * SLICE_BYTES
                    for at in range(lo, hi, SLICE_BYTES) if long else (lo,):
                        to = min(at + SLICE_BYTES + overlap, hi) if long else hi
                        own = np.array([0, to - at]) if long else offs[first:last + 1] - lo
                        for row, item, unit, edits, s, e in search(b, raw[at:to], own):
                            m = merged.setdefault((first + row, item), [set(), edits, at + s, at + e])
                            m[0].add(unit)
                            m[1:] = [min(m[1], edits), min(m[2], at + s), max(m[3], at + e)]
                rows = []
                for (row, item), (units, edits, s, e) in sorted(merged.items()):
                    begin = characters(raw[offs[row]:s])
                    rows.append((batch.column(0)[row].as_py(), b.ids[item], len(units), edits, begin,
                                 begin + characters(raw[s:e])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], names)

        found = found.unionByName(texts.mapInArrow(work, schema))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a region of any item; one pass per block, no join."""
    out = docs
    overlap = 4 * (WINDOW + 2 * CELL)
    for block in blocks(items, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches, shared=shared):
            for batch in batches:
                raw, offs = utf8(batch.column(text_col))
                clean = np.ones(batch.num_rows, bool)
                for first, last in slices(offs):
                    lo, hi = int(offs[first]), int(offs[last])
                    long = last == first + 1 and hi - lo > 2 * SLICE_BYTES
                    for at in range(lo, hi, SLICE_BYTES) if long else (lo,):
                        to = min(at + SLICE_BYTES + overlap, hi) if long else hi
                        own = np.array([0, to - at]) if long else offs[first:last + 1] - lo
                        for hit in search(shared.value, raw[at:to], own):
                            clean[first + hit[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(work, out.schema)
    return out
