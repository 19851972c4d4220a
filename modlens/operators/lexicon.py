"""Lexicon matching and scoring (channel search X1, lexicon classifier X2).

A lexicon is a DataFrame ``(term, category, lang)``; a term may hold several
words and is then matched as an n-gram of the post's tokens.

Two physical forms, chosen by the (checked) lexicon size:

Both give the same rows, also where a key repeats.

* inline (default up to ``INLINE_MAX_TERMS`` terms): the lexicon is collected to
  the driver (bounded by the check) and compiled into a literal set; matching
  is an array filter per row. No explode, no shuffle: the scan, tokenizer and
  match run map-only, and work on a stream unchanged. The literal ``IN`` list
  becomes a hash set (Catalyst's InSet) once it has more than a few entries.
* join: tokens are exploded (document text is dropped first), joined to the
  lexicon (broadcast only under ``BROADCAST_MAX_TERMS``), and regrouped by key;
  the only exchange is on the document key.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions.columns import flag_ge, ngrams, tokens
from modlens.operators.partitioning import spread
from modlens.session import checkpoint_root

INLINE_MAX_TERMS = 1000
BROADCAST_MAX_TERMS = 2_000_000
_SEP = "\u0001"

LEXICON_SCHEMA = "term string, category string, lang string"


def lexicon_frame(spark: SparkSession, rows: Iterable[tuple[str, str | None, str]]) -> DataFrame:
    """(term, category, lang) rows -> lexicon DataFrame. Terms go through the token rule of texts
    (lower-cased, split at everything but letters and digits), so a punctuated or hyphenated
    term is the n-gram of its parts; terms without a letter or digit are dropped."""
    clean = [(term, c, l) for t, c, l in rows if (term := clean_term(t))]
    return spark.createDataFrame(clean, LEXICON_SCHEMA)


def clean_term(term: str) -> str:
    """The term as texts are tokenised: letter and digit runs, lower-cased, single-spaced."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in term.lower()).split())


def _collect_bounded(lexicon: DataFrame, limit: int) -> list | None:
    rows = lexicon.select("term", "category", "lang").limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def _gram_sizes(terms: Iterable[str]) -> list[int]:
    return sorted({len(t.split(" ")) for t in terms})


def _all_grams(toks: Column, sizes: Sequence[int]) -> Column:
    arrays = [ngrams(toks, n) for n in sizes]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


PREFILTER_MAX_WORDS = 64


def _could_match(keys: Sequence[str], text_col: str, lang_col: str) -> Column:
    """Exact, cheap gate before tokenising: the post's language has terms, and
    (for small lexicons) the lower-cased text contains the longest word of some
    term as a substring -- a token or n-gram match implies both."""
    langs = sorted({k.split(_SEP, 1)[0] for k in keys})
    gate = F.col(lang_col).isin(langs)
    words = sorted({max(k.split(_SEP, 1)[1].split(" "), key=len) for k in keys})
    if len(words) <= PREFILTER_MAX_WORDS:
        low = F.lower(F.col(text_col))
        hit = None
        for w in words:
            c = low.contains(w)
            hit = c if hit is None else (hit | c)
        gate = gate & hit
    return F.coalesce(gate, F.lit(False))


def _inline_match(df: DataFrame, rows, text_col: str, lang_col: str) -> DataFrame:
    matched, result = _inline_columns(rows, text_col, lang_col)
    keep = [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn("_matched", matched).select(*keep, result)


def _inline_columns(rows, text_col: str, lang_col: str) -> tuple[Column, Column]:
    """The match column and the result generator for a bounded lexicon."""
    entries = tuple(sorted(((r["lang"], r["term"], r["category"]) for r in rows),
                           key=lambda e: (e[0], e[1], e[2] is None, e[2] or "")))
    cats: dict[str, set[str]] = defaultdict(set)
    for lang_v, term, category in entries:
        k = f"{lang_v}{_SEP}{term}"
        if category is not None:
            cats[k].add(category)
        else:
            cats.setdefault(k, set())
    keys = sorted(cats)
    sizes = _gram_sizes(k.split(_SEP, 1)[1] for k in keys) or [1]
    grams = _all_grams(tokens(F.col(text_col)), sizes)
    lang = F.col(lang_col)
    empty = F.array().cast("array<string>")
    if keys:
        matched = F.filter(grams, lambda g: F.concat(lang, F.lit(_SEP), g).isin(keys))
        matched = F.when(_could_match(keys, text_col, lang_col), matched).otherwise(empty)
    else:
        matched = empty
    cat_map = F.create_map(*[x for k in keys for x in (F.lit(k), F.array(*[F.lit(c) for c in sorted(cats[k])]).cast("array<string>"))]) \
        if keys else None
    terms = F.array_sort(F.array_distinct(F.col("_matched")))
    if cat_map is not None:
        categories = F.array_sort(F.array_distinct(F.flatten(F.transform(
            terms, lambda t: F.coalesce(F.element_at(cat_map, F.concat(lang, F.lit(_SEP), t)),
                                        F.array().cast("array<string>"))))))
    else:
        categories = F.array().cast("array<string>")
    # The match results leave through a one-row generator. Catalyst cannot
    # substitute generator outputs into filters pushed below it, so a later
    # filter on hits / terms / categories never re-inlines (and re-runs) the
    # tokenizer at the scan.
    result = F.inline(F.array(F.struct(F.size("_matched").cast("bigint").alias("hits"),
                                       terms.alias("matched_terms"),
                                       categories.alias("categories"))))
    return matched, result


#: A term that is more than one in this many of all matching n-grams is hot; so at most that many are.
HOT_SHARE = 4096


def _on_term(grams: DataFrame, lex: DataFrame) -> DataFrame:
    return grams.join(lex, (F.col("_lang") == lex["lang"]) & (F.col("_g") == lex["term"]))


def _shuffled_match(grams: DataFrame, lex: DataFrame) -> DataFrame:
    """Matches of a lexicon too large to broadcast, without a hot key.

    N-grams are first counted per (language, n-gram), partly in each task, and the counts alone meet the
    lexicon. Terms with more than one in ``HOT_SHARE`` of the matches, at most that many, are broadcast to
    the n-grams; what they don't match meets the other terms in a shuffle, where a key holds at most that
    share."""
    checkpoint_root(grams.sparkSession)
    counted = (grams.groupBy("_lang", "_g").agg(F.count(F.lit(1)).alias("_n")))
    used = _on_term(counted, lex).select("lang", "term", "cats", "_n").checkpoint()
    total = used.agg(F.sum("_n")).first()[0] or 0
    hot, cold = (used.where(c).select("lang", "term", "cats") for c in
                 (F.col("_n") * HOT_SHARE > total, F.col("_n") * HOT_SHARE <= total))
    rest = grams.join(F.broadcast(hot), (F.col("_lang") == hot["lang"]) & (F.col("_g") == hot["term"]), "left_anti")
    return _on_term(grams, F.broadcast(hot)).unionByName(_on_term(rest, cold))


def _join_match(df: DataFrame, lexicon: DataFrame, key: str, text_col: str, lang_col: str,
                small: bool) -> DataFrame:
    lex = (lexicon.groupBy("lang", F.array_join(tokens(F.col("term")), " ").alias("term"))
           .agg(F.array_sort(F.collect_set("category")).alias("cats")))
    # Distinct n-gram lengths present in the lexicon: a handful of small ints.
    sizes = sorted(int(r["n"]) for r in
                   lex.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())
    grams = _all_grams(tokens(F.col(text_col)), sizes or [1])
    # A row is its key, language and text digest: a repeated key keeps each row's own hits, and
    # equal rows share one result, as a match counts once per place in the text.
    row = F.struct(F.col(key).alias("k"), F.col(lang_col).alias("l"),
                   F.md5(F.col(text_col).cast("binary")).alias("t"))
    listed = df.select(row.alias("_row"), F.col(lang_col).alias("_lang"), grams.alias("_grams"))
    exploded = listed.select("_row", "_lang", F.posexplode("_grams").alias("_pos", "_g"))
    if small:
        matched = _on_term(exploded, F.broadcast(lex))
    else:
        matched = _shuffled_match(exploded, lex)
    placed = matched.groupBy("_row", "_pos").agg(F.first("term").alias("term"), F.first("cats").alias("cats"))
    per_row = placed.groupBy("_row").agg(
        F.count(F.lit(1)).alias("hits"),
        F.array_sort(F.collect_set("term")).alias("matched_terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cats")))).alias("categories"),
    )
    empty = F.array().cast("array<string>")
    return (df.withColumn("_row", row).join(per_row, "_row", "left").drop("_row")
            .withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
            .withColumn("matched_terms", F.coalesce("matched_terms", empty))
            .withColumn("categories", F.coalesce("categories", empty)))


def match_lexicon(df: DataFrame, lexicon: DataFrame | Sequence[tuple], key: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang", method: str = "auto",
                  broadcast_terms: int = BROADCAST_MAX_TERMS) -> DataFrame:
    """Add ``hits`` (matched token n-grams, repeats counted), ``matched_terms`` and
    ``categories`` (sorted, distinct) to every row of ``df``.

    ``lexicon`` is a (term, category, lang) DataFrame, or the same rows as a
    Python list. A term matches only posts of its own language. Rows without
    matches get 0 and empty arrays.
    """
    if method not in ("auto", "inline", "join"):
        raise ValueError(method)
    if not isinstance(lexicon, DataFrame):
        rows = [{"term": term, "category": c, "lang": l} for t, c, l in lexicon if (term := clean_term(t))]
        if method == "join" or len(rows) > INLINE_MAX_TERMS:
            lexicon = lexicon_frame(df.sparkSession, [(r["term"], r["category"], r["lang"]) for r in rows])
            rows = None
    else:
        rows = None
    df = spread(df, key)
    if rows is None and method != "join":
        rows = _collect_bounded(lexicon, INLINE_MAX_TERMS)
    if method == "inline" and rows is None:
        raise ValueError(f"lexicon has more than {INLINE_MAX_TERMS} terms; use method='join'")
    if rows is not None:
        return _inline_match(df, rows, text_col, lang_col)
    n_terms = lexicon.count()
    return _join_match(df, lexicon, key, text_col, lang_col, n_terms <= broadcast_terms)


def lexicon_score(df: DataFrame, lexicon: DataFrame | Sequence[tuple], key: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", threshold: float = 0.5, method: str = "auto") -> DataFrame:
    """Lexicon classifier: ``toxicity = hits / (hits + 1)`` in [0, 1) and
    ``pred = toxicity >= threshold`` (inclusive; NaN/NULL -> 0)."""
    m = match_lexicon(df, lexicon, key=key, text_col=text_col, lang_col=lang_col, method=method)
    tox = F.col("hits").cast("double") / (F.col("hits").cast("double") + F.lit(1.0))
    return m.withColumn("toxicity", tox).withColumn("pred", flag_ge(F.col("toxicity"), threshold))


def channel_search(df: DataFrame, query: Mapping[str, Sequence[str]],
                   platforms: Mapping[str, Sequence[str]] | None = None,
                   lang_col: str = "lang", text_col: str = "text", platform_col: str = "source",
                   url_col: str | None = None, key: str | None = None) -> DataFrame:
    """Posts matching a channel spec: any term of the post's language (as a token
    n-gram), on one of the listed platforms, and when a platform lists path
    prefixes, with a URL under one of them. Map-only (``arrays_overlap``)."""
    toks = tokens(F.col(text_col))
    cond = None
    for lang, terms in query.items():
        clean = sorted({c for t in terms if (c := clean_term(t))})
        if not clean:
            continue
        grams = _all_grams(toks, _gram_sizes(clean))
        # exact gate first (language, and a term word in the lower-cased text), so
        # posts that cannot match are never tokenised; And short-circuits
        gate = _could_match([f"{lang}{_SEP}{t}" for t in clean], text_col, lang_col)
        hit = gate & F.arrays_overlap(grams, F.array(*[F.lit(t) for t in clean]))
        cond = hit if cond is None else (cond | hit)
    if cond is None:
        cond = F.lit(False)
    df = spread(df, key)
    if platforms is not None:
        pcond = None
        for name, paths in platforms.items():
            c = F.col(platform_col) == F.lit(name)
            if paths:
                if url_col is None:
                    raise ValueError("path prefixes need url_col")
                c = c & path_matches(F.col(url_col), paths)
            pcond = c if pcond is None else (pcond | c)
        cond = cond & (pcond if pcond is not None else F.lit(False))
    return df.where(F.coalesce(cond, F.lit(False)))



def url_host_path(url: Column) -> Column:
    """URL without scheme, query and fragment: ``host/path``."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path component of a URL ('' when there is none)."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*(/[^?#]*)?", 1)


def path_matches(url: Column, prefixes: Sequence[str]) -> Column:
    """True when the URL falls under any prefix. A prefix starting with '/'
    is matched against the path; otherwise against ``host/path``
    (e.g. 'forum.example/garden', with or without a leading 'www.')."""
    cond = F.lit(False)
    hp = F.regexp_replace(url_host_path(url), r"^www\.", "")
    p = url_path(url)
    for pre in prefixes:
        target = p if pre.startswith("/") else hp
        cond = cond | target.startswith(pre)
    return cond


def path_filter(df: DataFrame, prefixes: Sequence[str], url_col: str = "url") -> DataFrame:
    return df.where(path_matches(F.col(url_col), prefixes))
