"""Language identification by rank-order n-gram profiles.

Learning counts the character 1- to 3-grams of all labelled texts per language and keeps each
language's most frequent ones, in rank order: its profile. A document is ranked the same way
and goes to the language with the smallest out-of-place distance: for each of the document's
most frequent n-grams, how far its rank is from its rank in the profile (the profile's length
where it is absent).

Texts are lowered, every run of other characters than letters is one blank, and n-grams don't
cross a blank. Whole texts are read, sorted as 64-bit codes in slices, so memory is bounded by
the slice; a text longer than a slice is counted in pieces that are then merged. Profiles are
bounded by languages times ``top``.

Nulls and ties: a null text, or one without letters, is ``und`` with score 0; a row without id
counts as the id ''; rows without language teach nothing; equal counts rank by code, equal
distances go to the first language in code-point order; repeated rows are each returned; with
nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import schema_with

UNKNOWN = "und"
TOP = 400
PIECE, RUN = 1 << 17, 1 << 12
FOLDS = 5
#: Distinct n-grams a learning task holds before it passes its counts on.
HELD = 1 << 20

_FOLD: dict[int, np.ndarray] = {}


def letters() -> np.ndarray:
    """Code point to the code of its lower-case letter; 1 (a blank) for all else.

    Codes keep the low 16 bits of the code point, so an n-gram and a row fit in 64 bits."""
    if 0 not in _FOLD:
        table = np.ones(0x110000, np.uint16)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = max(ord(low if len(low) == 1 else chr(c)) & 0xFFFF, 2)
        _FOLD[0] = table
    return _FOLD[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row of each code) of the texts, with single blanks around and between words."""
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    c = letters()[raw]
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(ends, prepend=0))[:len(c)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1)  # one blank of a run; it also parts two rows
    return c[keep].astype(np.uint64), row[keep]


def grams(c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sorted keys (row << 48 | n-gram) of all 1- to 3-grams."""
    if not len(c):
        return c
    one = np.uint64(1)
    pad = np.concatenate(([one], c, [one]))
    rows = np.concatenate((row[:1], row, row[-1:])) << np.uint64(48)
    solid = pad != one
    out = [rows[solid] | pad[solid]]
    # A blank that ends one row also begins the next: the row of an n-gram is that of its letter.
    two = (pad[:-1] << np.uint64(16)) | pad[1:]
    at = np.where(solid[:-1], rows[:-1], rows[1:])
    ok = solid[:-1] | solid[1:]
    out.append((at | two)[ok])
    three = (two[:-1] << np.uint64(16)) | pad[2:]
    ok = solid[1:-1] & (solid[:-2] | solid[2:])
    out.append((rows[1:-1] | three)[ok])
    return np.sort(np.concatenate(out))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts added."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def pieces(text: str):
    """Parts of a long text, cut at a blank, so that no n-gram is lost or made; a run of letters is cut
    only where it goes on for more than RUN letters past a part's size."""
    a = 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        while b < min(len(text), a + PIECE + RUN) and text[b - 1].isalpha() and text[b].isalpha():
            b += 1
        yield text[a:b]
        a = b


def groups(texts: list[str]):
    """(first, texts) of up to PIECE characters together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and (size + len(t) > PIECE or len(held) >= 1 << 14):
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def gram_counts(texts: list[str]):
    """(first row, keys, counts) for groups of texts."""
    for first, held in groups(texts):
        if len(held) == 1 and len(held[0]) > PIECE:
            keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            for part in pieces(held[0]):
                k, m = counted(grams(*codes([part])))
                keys, n = merged(np.concatenate((keys, k)), np.concatenate((n, m)))
            yield first, keys, n
        else:
            yield first, *counted(grams(*codes(held)))


def ranked(keys: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank) of each row's most frequent n-grams, ties by code."""
    if not len(keys):
        return keys.astype(np.int64), keys, keys.astype(np.int64)
    row = (keys >> np.uint64(48)).astype(np.int64)
    if len(keys) >= 1 << 24:  # one very long text
        at = np.lexsort((keys, -n))[:top]
        return row[at], keys[at] & np.uint64((1 << 48) - 1), np.arange(len(at))
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    # row (16) | frequent first (24) | place among this group's keys (24): one plain sort ranks all
    less = np.uint64(1 << 24) - np.minimum(n, (1 << 24) - 1).astype(np.uint64)
    place = np.sort((row.astype(np.uint64) << np.uint64(48)) | ((less - np.uint64(1)) << np.uint64(24))
                    | np.arange(len(keys), dtype=np.uint64))
    at = (place & np.uint64((1 << 24) - 1)).astype(np.int64)
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
    keep = rank < top
    return row[keep], keys[at][keep] & np.uint64((1 << 48) - 1), rank[keep]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """{language: n-grams, most frequent first}, counted over all rows given."""
    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for name, parts in held.items():
                k, n = merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).to_pylist()
            for name in sorted(set(names)):
                for _, part in groups([texts[i] for i in np.flatnonzero(names == name)]):
                    for whole in ([part] if len(part) > 1 else [[p] for p in pieces(part[0])]):
                        c, row = codes(whole)
                        k, n = counted(grams(c, np.zeros_like(row)))
                        held.setdefault(name, []).append((k, n))
                        size += len(k)
                        if len(held[name]) >= 16:
                            parts = held[name]
                            size -= sum(len(x[0]) for x in parts)
                            held[name] = [merged(np.concatenate([x[0] for x in parts]),
                                                 np.concatenate([x[1] for x in parts]))]
                            size += len(held[name][0][0])
            if size > HELD:
                yield from out()
                size = 0
        yield from out()

    rows = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
            .mapInArrow(count, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, list[int]] = {}
    for r in (rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
              .select("lang", "gram", "r").collect()):
        out.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {k: [g for _, g in sorted(out[k])] for k in sorted(out)}


def predict(docs: DataFrame, learned: dict[str, list[int]], text: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score", top: int = TOP, drop_text: bool = False) -> DataFrame:
    """The rows with a language and a score: 1 less the mean out-of-place distance over ``top``."""
    names = [*learned]
    known = np.array(sorted({g for p in learned.values() for g in p}), np.uint64)
    places = np.full((len(known) + 1, len(names)), top, np.int32)
    for j, p in enumerate(learned.values()):
        places[np.searchsorted(known, np.array(p, np.uint64)), j] = np.arange(len(p))
    shared = docs.sparkSession.sparkContext.broadcast((names, known, places))
    others = [c for c in docs.columns if c not in (lang_col, score_col) and not (drop_text and c == text)]

    def label(batches):
        names, known, places = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                for first, keys, n in gram_counts([t or "" for t in texts]):
                    row, gram, rank = ranked(keys, n, top)
                    if not len(row):
                        continue
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    where = places[np.where(known[at] == gram, at, len(known))]
                    off = np.where(where == top, top, np.abs(where - rank[:, None]))
                    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    size = np.diff(np.append(starts, len(row)))
                    mean = np.add.reduceat(off, starts, axis=0) / size[:, None]
                    for r, j, d in zip((first + row[starts]).tolist(), mean.argmin(1).tolist(), mean.min(1).tolist()):
                        langs[r], scores[r] = names[j], 1 - d / top
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(langs, pa.string()), pa.array(scores)],
                [*others, lang_col, score_col])

    return (docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*others, text])])
            .mapInArrow(label, schema_with(docs, others, f"`{lang_col}` string, `{score_col}` double")))


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0
