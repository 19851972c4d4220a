"""Column-level helpers (all JVM-side built-ins; no Python UDFs).

NaN semantics: in Spark NaN sorts above every number and ``NaN >= 0.5`` is
TRUE, unlike pandas. Every threshold here is guarded so NaN and NULL give 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern: runs of anything that is not a letter or a digit separate tokens.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
WHITESPACE_SPLIT = r"\s+"

# 2**52: the md5 uniform takes 13 hex digits (52 bits) of the digest.
MD5_UNIFORM_SCALE = 4503599627370496.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_string(*parts: str | Column | int) -> Column:
    """``a:b:c`` with every part cast to string (ints render without decimals)."""
    cols = [F.lit(str(p)) if isinstance(p, int) else _col(p).cast("string") for p in parts]
    return F.concat_ws(":", *cols)


def md5_hex(*parts: str | Column | int) -> Column:
    return F.md5(key_string(*parts))


def md5_uniform(*parts: str | Column | int) -> Column:
    """Deterministic uniform in [0, 1) from md5 of ``parts`` joined by ':'."""
    h = md5_hex(*parts)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(MD5_UNIFORM_SCALE)


def flag_gt(score: str | Column, threshold: float) -> Column:
    """1 when score > threshold, else 0; NaN and NULL give 0 (strict)."""
    s = _col(score)
    return F.when(~F.isnan(s) & (s > F.lit(threshold)), 1).otherwise(0).cast("int")


def flag_ge(score: str | Column, threshold: float) -> Column:
    """1 when score >= threshold, else 0; NaN and NULL give 0 (inclusive)."""
    s = _col(score)
    return F.when(~F.isnan(s) & (s >= F.lit(threshold)), 1).otherwise(0).cast("int")


def flag_eq(c: str | Column, value) -> Column:
    """1 when c equals value, else 0 (NULL gives 0)."""
    return F.when(_col(c) == F.lit(value), 1).otherwise(0).cast("int")


def sanitize_label(c: str | Column) -> Column:
    """Keep a label that is 0 or 1, else 0. A string is parsed first ('1', '1.0' -> 1).

    The strict rule (only typed numbers survive, every string -> 0) is chosen by
    the caller from the schema: see ``operators.prep.sanitize_label_column``.
    """
    num = _col(c).try_cast("double")
    return F.when((num == 0.0) | (num == 1.0), num).otherwise(F.lit(0.0)).cast("int")


def sanitize_numeric_label(c: str | Column) -> Column:
    """Typed numeric label: keep 0/1, anything else (NaN, NULL, 2) -> 0."""
    x = _col(c)
    return F.when(x.isin(0, 1), x).otherwise(F.lit(0)).cast("int")


def numeric_guard(c: str | Column) -> Column:
    """Parse a mixed column as double; NaN, NULL and text become 0.0."""
    x = _col(c).try_cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def fill_cast(c: str | Column, dtype: str = "int", fill=0) -> Column:
    """``fillna(fill).astype(dtype)``; NaN counts as missing."""
    x = _col(c)
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(fill)).cast(dtype)


def split_words(c: str | Column, lower: bool = True, pattern: str = WHITESPACE_SPLIT) -> Column:
    """Split on whitespace runs (optionally lower-casing); NULL -> empty array."""
    x = _col(c)
    if lower:
        x = F.lower(x)
    parts = F.filter(F.split(x, pattern), lambda t: t != F.lit(""))
    return F.coalesce(parts, F.array().cast("array<string>"))


def tokens(c: str | Column) -> Column:
    """Lower-cased letter/digit tokens of a text; NULL -> empty array."""
    return split_words(c, lower=True, pattern=TOKEN_SPLIT)


def first_tokens(c: str | Column, n: int) -> Column:
    """The first ``n`` of ``tokens``; the text behind them is not split."""
    # one piece more for an empty one in front, and one for the rest of the text
    parts = F.split(F.lower(_col(c)), TOKEN_SPLIT, n + 2)
    found = F.slice(F.filter(parts, lambda t: t != F.lit("")), 1, n)
    return F.coalesce(found, F.array().cast("array<string>"))


def ngrams(toks: Column, n: int) -> Column:
    """Space-joined n-grams of a token array (n = 1 returns the tokens).

    The array is zipped with itself, shifted: an expression for the tokens is evaluated a few
    times per row, not once per n-gram."""
    if n == 1:
        return toks
    grams = toks
    for j in range(1, n):
        shifted = F.slice(toks, j + 1, F.greatest(F.size(toks), F.lit(1)))
        grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull())


def sigmoid(z: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def softplus(x: str | Column) -> Column:
    """log(1 + exp(x)) in the overflow-safe form."""
    v = _col(x)
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


def dot(vec: str | Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """w . v + b over an array column, in double, summed left to right."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    prods = F.zip_with(_col(vec), w, lambda a, b: a.cast("double") * b)
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x) + F.lit(float(bias))


def lower_columns(names: Iterable[str]) -> list[str]:
    lowered = [n.lower() for n in names]
    seen: set[str] = set()
    for n in lowered:
        if n in seen:
            raise ValueError(f"lower-casing column names collides on {n!r}")
        seen.add(n)
    return lowered
