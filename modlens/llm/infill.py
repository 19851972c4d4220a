"""Fill-in-middle transformation: unit ends marked and selected in 64-bit words (SWAR).

Units. A text is cut into units ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, left to right.
All white space of that pattern is ASCII, so a unit ends at a byte that isn't white space and is followed
by white space, and at a text's last byte. The UTF-8 bytes of many texts are viewed as uint64. Per word,
white space is found arithmetically (no carry leaves a byte), shifted against itself by one byte, and each
unit-ending byte keeps its high bit. ``bitwise_count`` of the words and their running sum give ranks; the
k-th end of a text is found by a binary search for its word and a byte-wise prefix sum inside the word
(one multiplication). Code points are counted in the same way, from the bytes that begin one.

Transformation. h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:`` and the decimal
id. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger,
the suffix is the rest. A text is left plain if it is empty, holds a marker, or h3 % 100 >= ``rate``;
otherwise it is ``spm`` if h4 % 100 < ``spm_rate``, else ``psm``. ``restored`` undoes it.

Memory: texts are taken in slices of about 0.5 MB, a longer text alone; words are marked in blocks of
``BLOCK``, so a long text costs about six times its own bytes. Map-only: nothing is shuffled.

Nulls and ties: a null text counts as empty; an empty text has no units and is plain; a null id hashes as
the empty string; repeated rows give equal rows; an empty table gives none. Only the id and text columns are
read, so other columns, of whatever name, have no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import slices, utf8, workers_find_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = "42", 50, 80
#: Words marked at once.
BLOCK = 1 << 15

HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONES = np.uint64(0x0101010101010101)
SPACES = np.uint64(0x20) * ONES
FROM_TAB = np.uint64(0x80 - 0x09) * ONES   # added to a byte under 0x80, sets its high bit from 0x09 on
AFTER_CR = np.uint64(0x80 - 0x0E) * ONES   # and from 0x0E on


def padded(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, filled up with one to eight blanks."""
    room = np.full((len(data) + 8) // 8 * 8, 0x20, np.uint8)
    room[:len(data)] = data
    return room.view("<u8")


def space_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is one of 09-0D or 20."""
    low = words & LOW
    blank = ~((low ^ SPACES) + LOW)
    control = (low + FROM_TAB) & ~(low + AFTER_CR)
    return (blank | control) & ~words & HIGH


def end_marks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The high bit of each byte that ends a unit; text i is ``data[offs[i]:offs[i + 1]]``."""
    words = padded(data)
    out = np.empty_like(words)
    for a in range(0, len(words), BLOCK):
        b = min(a + BLOCK, len(words))
        space = space_marks(words[a:b + 1])
        after = space[:b - a] >> np.uint64(8)
        after[:len(space) - 1] |= space[1:] << np.uint64(56)
        out[a:b] = ~space[:b - a] & after & HIGH
    last = offs[1:][np.diff(offs) > 0] - 1
    out.view(np.uint8)[last] = 0x80
    return out


def start_marks(data: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point, that is, whose top bits aren't 10."""
    words = padded(data)
    out = np.empty_like(words)
    for a in range(0, len(words), BLOCK):
        w = words[a:a + BLOCK]
        out[a:a + BLOCK] = (~w | (w << np.uint64(1))) & HIGH
    return out


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in front of each byte place."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7) << 3).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte place of each nth mark, counted from 1."""
        word = np.searchsorted(self.before, nth) - 1
        inside = (nth - self.before[word]).astype(np.uint64)
        upto = (self.marks[word] >> np.uint64(7)) * ONES       # each byte: marks up to and with it
        reached = ((upto | HIGH) - inside * ONES) & HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def unit_cuts(data: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, end of prefix, end of middle, code points of prefix, of middle) of each text; ends are byte places."""
    ends = Marks(end_marks(data, offs))
    first = ends.rank(offs[:-1])
    n = ends.rank(offs[1:]) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place = offs[:-1].copy()
        some = k > 0
        place[some] = ends.select((first + k)[some]) + 1
        places.append(place)
    starts = Marks(start_marks(data))
    at = [starts.rank(x) for x in (offs[:-1], *places)]
    return n, *places, at[1] - at[0], at[2] - at[1]


def id_hashes(key: Column, seed: str) -> list[Column]:
    """Four 32-bit numbers of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per input row."""
    workers_find_package(docs.sparkSession)
    h = id_hashes(F.col("id"), seed)
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
            .select("id", "text", h[0].alias("h1"), h[1].alias("h2"),
                    F.when((F.col("text") == "") | (h[2] % 100 >= rate), "plain")
                    .when(h[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form")))
    tags = [t.encode() for t in (PREFIX, SUFFIX, MIDDLE)]

    def work(batches):
        for batch in batches:
            raw, offs = utf8(batch.column(1))
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            held = [pc.match_substring(batch.column(1), t) for t in (PREFIX, SUFFIX, MIDDLE)]
            marked = pc.or_(pc.or_(*held[:2]), held[2])
            form = pc.if_else(marked, "plain", batch.column(4))
            for a, b in slices(offs):
                data, own = raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                n, p, m, pc_, mc = unit_cuts(data, own, h1[a:b], h2[a:b])
                kind = form.slice(a, b - a)
                text, out = data.tobytes(), []
                for k, s, i, j, e in zip(kind.to_pylist(), own[:-1].tolist(), p.tolist(), m.tolist(), own[1:].tolist()):
                    if k == "psm":
                        out.append(b"".join((tags[0], text[s:i], tags[1], text[j:e], tags[2], text[i:j])))
                    elif k == "spm":
                        out.append(b"".join((tags[1], text[j:e], tags[0], text[s:i], tags[2], text[i:j])))
                    else:
                        out.append(text[s:e])
                plain = pc.equal(kind, "plain").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), kind,
                     pa.array(pc_, pa.int64(), mask=plain), pa.array(mc, pa.int64(), mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
    return (rows.mapInArrow(work, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
            .withColumnRenamed("id", id_col))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. A marker can't arise across a seam, as none begins with
    another's end, and texts that hold one are plain."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    psm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3)     # prefix, suffix, middle
    spm = F.split(body, f"{PREFIX}|{MIDDLE}", 3)     # suffix, prefix, middle
    return (F.when(form == "psm", F.concat(F.get(psm, F.lit(0)), F.get(psm, F.lit(2)), F.get(psm, F.lit(1))))
            .when(form == "spm", F.concat(F.get(spm, F.lit(1)), F.get(spm, F.lit(2)), F.get(spm, F.lit(0))))
            .otherwise(output))
