"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

Base spans come from fixed patterns (email, ip, card, phone; leftmost, non-overlapping per kind).
The field reads word shapes only (runs of digits, cases and punctuation, lengths, and the shapes
of the neighbours), is fitted on a small labelled table, and is decoded by Viterbi for a whole
Arrow batch at once in numpy. It adds spans the patterns can't see: phone numbers without a plus
sign, secrets after a key name, access keys. A base span always stays; an added span that touches
one is dropped.

Chains. A word without a digit or at sign that is more than ``CONTEXT`` words from one that has
them is no part of a chain: such stretches hold no personal data in this model, so texts without
any digit or at sign are never decoded. Chains are decoded whole, however long.

Offsets are code points, ends exclusive. Nulls and ties: a null text counts as empty; empty texts
have no spans; very long texts are searched whole, in time linear in their length; repeated rows
get the same spans; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm.common import schema_with, utf8

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
CONTEXT = 3
#: Words, padding included, that are decoded together; a longer chain is decoded alone.
CELLS = 1 << 16
#: Rows of the labelled table that are used for fitting; more are refused.
MAX_LABELLED = 5000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@domain``: each holds one at sign, so they are built around it."""
    done, at = 0, text.find("@")
    while at >= 0:
        reach = 64
        while True:
            left = text[max(done, at - reach):at]
            run = len(left) - len(left.rstrip(LOCAL))
            if run < len(left) or at - reach <= done:
                break
            reach *= 4
        m = DOMAIN.match(text, at + 1) if run else None
        if m:
            done = m.end()
            yield at - run, done
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# Word shapes -------------------------------------------------------------------------------

WORD = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|"


def shape(word: str) -> str:
    """Cases and digits as classes; punctuation as it is."""
    return "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)


def checks(text: str) -> bool:
    """Whether the ASCII digits of a text pass the Luhn check."""
    return luhn("".join(c for c in text if "0" <= c <= "9"))


def plausible(kind: str, text: str) -> bool:
    """What an added span of a kind must meet, whatever the field says."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return "@" in text
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= digits <= 19 and checks(text)
    if kind == "phone":
        return 7 <= digits <= 15
    return len(text) >= 8 and digits > 0


RUN = re.compile(r"(.)\1*")


@lru_cache(1 << 16)
def own_features(word: str) -> tuple[str, ...]:
    long = shape(word)
    short = RUN.sub(r"\1", long)
    digits, n = long.count("9"), len(word)
    return (f"s={short[:12]}", f"l={RUN.sub(lambda m: m.group()[:5], long)[:40]}",
            f"d={min(digits, 20)}", f"n={min(n.bit_length(), 8)}",
            f"m={digits > 0}{'a' in long}{'A' in long}{'@' in word}{'=' in word}",
            f"f={long[:1]}", f"e={long[-1:]}", f"c={digits if 13 <= digits <= 19 and checks(word) else 0}", f"w={word.lower().strip(EDGE + '=')[:12]}" if digits == 0 else "w=9")


def features(words: list[str]) -> list[tuple[str, ...]]:
    """Features of each word of a chain: its own, and the short shapes around it."""
    own = [own_features(w) for w in words]
    around = [o[0] for o in own]
    return [(*own[i], "p" + (around[i - 1] if i else "^"), "q" + (around[i + 1] if i + 1 < len(own) else "$"),
             f"P{own[i - 1][-1] if i else '^'}") for i in range(len(own))]


# The labelled table ------------------------------------------------------------------------

#: Key names, and phrases with a place for a value. "{}" is personal data of the kind
#: named; the last group has numbers that aren't.
KEY_NAMES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "pwd")
PLAIN = ("on the {}", "version {} of it", "see page {} and then", "licensed under cc by-nc {}", "in {} the house",
         "chapter {} begins", "about {} people", "the public license, version {}", "cost {} each", "at {} today",
         "between {} and later", "row {} | x", "total {} items", "nr. {} der", "le {} mai", "de {} años")


def labelled_rows(n: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The default labelled table: (text, spans), made by rule."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    name = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 9)))

    def value(kind):
        if kind == "email":
            return f"{name()}{r.choice(['.', '_', ''])}{r.choice([name(), digits(2)])}@{name()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'de'])}"
        if kind == "ip":
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = "4" + digits(14)
            d += next(c for c in "0123456789" if luhn(d + c))
            sep = r.choice(["", "", " ", "-"])
            return sep.join(d[i:i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
                             f"+{r.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}"])
        return r.choice([hexes(r.randint(16, 40)), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))])

    def number():
        if r.random() < 0.15:  # long numbers that are no cards
            d = digits(r.randint(13, 19))
            return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 5) % 10)
        return r.choice([
            digits(1), digits(2), digits(3), digits(4), str(r.randint(1900, 2030)), f"{digits(1)}.{digits(1)}",
            f"{digits(1)}.0.", f"{digits(1)}.", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}%", f"${digits(2)}.{digits(2)}",
            f"{digits(1)},{digits(3)}", f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(5)}",
            f"{digits(2)}/{digits(2)}/{r.randint(1900, 2030)}", f"({digits(4)})", f"{digits(1)}th", f"#{digits(3)}", f"[{digits(2)}]",
            f"{digits(1)}.{digits(1)}.{digits(1)}", f"{r.randint(1900, 1999)}-{r.randint(2000, 2030)}", f"x{digits(2)}", f"{name()}{digits(1)}"])

    out = []
    for i in range(n):
        words = [w.capitalize() if r.random() < 0.15 else w for w in (name() for _ in range(r.randint(0, 5)))]
        tail = [name() + r.choice(["", "", ".", ",", "***", "%%%"]) for _ in range(r.randint(0, 5))]
        text, spans = " ".join(words), []
        if i % 2:
            kind = KINDS[i // 2 % len(KINDS)]
            v = value(kind)
            head = ""
            if kind == "secret" and not v.startswith("AKIA"):
                key = r.choice(KEY_NAMES)
                head = key + r.choice(["=", ' = "', ": ", "= "])
            text += (" " if text else "") + head
            spans.append((kind, len(text), len(text) + len(v)))
            text += v + ('"' if head.endswith('"') else r.choice(["", "", ".", ",", "###", "***"]))
        else:
            text += (" " if text else "") + r.choice(PLAIN).format(number()) + r.choice(["", "", "***", "%%%"])
        out.append((" ".join([text, *tail]), spans))
    return out


def labelled_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(
        [(t, [{"kind": k, "start": s, "end": e} for k, s, e in spans]) for t, spans in rows or labelled_rows()],
        "text string, spans array<struct<kind:string,start:int,end:int>>")


# The field ---------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: An inside label follows only a first or an inside one of its kind.
ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] for b in LABELS] for a in LABELS])
START = np.array([a[0] != "I" for a in LABELS])
NEVER = -1e4


class Field:
    """weights: (feature, label); moves: (label, label)."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def emissions(self, chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in chains])
        rows = [self.index.get(f, len(self.index)) for c in chains for fs in features(c) for f in fs]
        scores = self.weights[np.array(rows).reshape(int(lengths.sum()), -1)].sum(1)
        out = np.zeros((len(chains), int(lengths.max()), len(LABELS)))
        out[np.arange(out.shape[1]) < lengths[:, None]] = scores
        return out, lengths

    def decode(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Best labels of every chain: Viterbi over all chains at once."""
        e, lengths = self.emissions(chains)
        best = e[:, 0] + np.where(START, 0, NEVER)
        back = np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            via = best[:, :, None] + self.moves
            back[:, t] = via.argmax(1)
            step = via.max(1) + e[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        at = best.argmax(1)
        out = np.zeros(e.shape[:2], np.int64)
        for t in range(e.shape[1] - 1, -1, -1):
            live = t < lengths
            out[live, t] = at[live]
            at = np.where(live, back[np.arange(len(at)), t, at], at)
        return [out[i, :n] for i, n in enumerate(lengths.tolist())]


def word_labels(text: str, spans) -> tuple[list[str], list[int]]:
    words, labels, last = [], [], None
    for m in WORD.finditer(text):
        hit = next((s for s in spans if s[1] < m.end() and m.start() < s[2]), None)
        words.append(m.group())
        labels.append(0 if hit is None else LABELS.index(("I-" if hit == last else "B-") + hit[0]))
        last = hit
    return words, labels


def fit(rows, rounds: int = 150, l2: float = 0.02, rate: float = 0.3) -> Field:
    """Maximum likelihood by full-batch gradient steps (adaptive per weight); forward-backward in
    numpy over all chains of the labelled table, which is small by contract."""
    data = [word_labels(t, s) for t, s in rows if t and t.split()]
    chains = [w for w, _ in data]
    names = sorted({f for c in chains for fs in features(c) for f in fs})
    index = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(c) for c in chains])
    n, k = int(lengths.max()), len(LABELS)
    mask = np.arange(n) < lengths[:, None]
    ids = np.array([[index[f] for f in fs] for c in chains for fs in features(c)])
    gold = np.concatenate([y for _, y in data])
    y = np.zeros((len(chains), n), np.int64)
    y[mask] = gold
    w, moves = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    blocked = np.where(ALLOWED, 0, NEVER)
    seen_w, seen_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    gold_w = np.zeros_like(w)
    for j in range(ids.shape[1]):
        np.add.at(gold_w, (ids[:, j], gold), 1)
    gold_m = np.zeros_like(moves)
    pair = mask[:, 1:]
    np.add.at(gold_m, (y[:, :-1][pair], y[:, 1:][pair]), 1)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(rounds):
        e = np.zeros((len(chains), n, k))
        e[mask] = w[ids].sum(1)
        step = moves + blocked
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0] + np.where(START, 0, NEVER)
        for t in range(1, n):
            a[:, t] = np.where(mask[:, t, None], lse(a[:, t - 1, :, None] + step, 1) + e[:, t], a[:, t - 1])
        b = np.zeros_like(e)
        for t in range(n - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], lse(step + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])[mask]
        grad = gold_w - l2 * w
        for j in range(ids.shape[1]):
            np.subtract.at(grad, ids[:, j], p)
        both = np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad_m = gold_m - l2 * moves - both[pair].sum(0)
        seen_w += grad * grad
        seen_m += grad_m * grad_m
        w += rate * grad / np.sqrt(seen_w)
        moves += rate * grad_m / np.sqrt(seen_m)
    w[-1] = 0
    return Field(index, w, moves + blocked)


def chains_of(text: str) -> list[list[re.Match]]:
    """Runs of words near a word with a digit or an at sign."""
    words = list(WORD.finditer(text))
    near = [i for i, m in enumerate(words) if any(c.isdigit() or c == "@" for c in m.group())]
    out, last = [], -1
    for i in near:
        a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        if a <= last:
            out[-1].extend(words[last:b])
        else:
            out.append(words[a:b])
        last = b
    return [c for c in out if c]


def added_spans(chain: list[re.Match], labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(chain):
        label = LABELS[labels[i]]
        if label == "O":
            i += 1
            continue
        j = i + 1
        while j < len(chain) and LABELS[labels[j]] == "I-" + label[2:]:
            j += 1
        text = chain[i].string[chain[i].start():chain[j - 1].end()]
        start = chain[i].start()
        if label[2:] == "secret" and "=" in text:
            start += text.index("=") + 1
            text = text[text.index("=") + 1:]
        left = text.lstrip(EDGE.replace("(", "") if label[2:] == "phone" else EDGE)
        right = left.rstrip(EDGE)
        start += len(text) - len(left)
        if plausible(label[2:], right):
            out.append((label[2:], start, start + len(right)))
        i = j
    return out


def find(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the texts are decoded together."""
    base = [base_spans(t) for t in texts]
    chains = [(i, c) for i, t in enumerate(texts) for c in chains_of(t)]
    extra: list[list] = [[] for _ in texts]
    chains.sort(key=lambda c: len(c[1]))
    a = 0
    while a < len(chains):  # at most CELLS words with padding, or one chain, however long
        b = a + 1
        while b < len(chains) and (b + 1 - a) * len(chains[b][1]) <= CELLS:
            b += 1
        part, a = chains[a:b], b
        for (i, c), labels in zip(part, field.decode([[m.group() for m in c] for _, c in part])):
            extra[i].extend(added_spans(c, labels))
    out = []
    for b, x in zip(base, extra):
        free, taken = [], sorted((s, e) for _, s, e in b)
        for kind, s, e in sorted(set(x), key=lambda v: v[1]):
            at = np.searchsorted([v[0] for v in taken], e) if taken else 0
            if not any(v[1] > s for v in taken[max(0, at - 4):at]):
                free.append((kind, s, e))
        out.append((b, sorted(b + free, key=lambda v: (KINDS.index(v[0]), v[1]))))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FLAG = np.zeros(256, bool)
FLAG[[*range(48, 58), 64]] = True
FLAG[128:] = False


def learned(labelled: DataFrame | None) -> Field:
    if labelled is None:
        return fit(labelled_rows())
    rows = labelled.select("text", "spans").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    return fit([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or []]) for r in rows])


def scan(docs: DataFrame, fields: str, result, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """The other columns of docs, and what ``result(text, base, spans)`` gives for the schema ``fields``."""
    field = docs.sparkSession.sparkContext.broadcast(learned(labelled))
    names = [f.split()[0] for f in fields.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in fields.split(", ")]
    others = [c for c in docs.columns if c not in (text_col, *names)]

    def work(batches):
        for batch in batches:
            col = batch.column(text_col)
            raw, offs = utf8(col)
            n = len(col)
            hits = np.flatnonzero(FLAG[raw[offs[0]:offs[-1]]]) + offs[0]
            rows = np.unique(np.searchsorted(offs, hits, side="right") - 1)
            found: dict[int, tuple] = {}
            for a in range(0, len(rows), 256):
                part = rows[a:a + 256].tolist()
                texts = [col[i].as_py() for i in part]
                found.update(zip(part, find(field.value, texts)))
            out = [result(col[i], *found.get(i, ([], []))) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *(pa.array([o[j] for o in out], t) for j, t in enumerate(types))], [*others, *names])

    return (docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))
            .mapInArrow(work, schema_with(docs, others, fields)))


NO_SPANS = hashlib.sha256(b"").hexdigest()


def personal_data(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """The other columns with base counts, the digest of the base spans, and all spans as text."""
    def result(_, base, spans):
        counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest() if base else NO_SPANS, joined(spans),
                len(spans) - len(base))

    return scan(docs, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
                      "n_added bigint", result, text_col, labelled)


def redacted(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets, columns in their order; null texts stay null."""
    def result(text, _, spans):
        if not spans:
            return (text.as_py(),)
        s, out, at = text.as_py(), [], 0
        for kind, a, b in sorted(spans, key=lambda v: (v[1], -v[2])):
            if b <= at:
                continue
            out += [s[at:max(a, at)], f"[{kind.upper()}]"]
            at = b
        return ("".join(out) + s[at:],)

    clean = scan(docs, f"{text_col} string", result, text_col, labelled)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
