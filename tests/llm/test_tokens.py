import numpy as np
import pytest

from modlens.llm.common import documents
from modlens.session import scratch_path
from modlens.llm.tokens import (NARROW, VOCABULARY, WIDE, Layout, encode, id_words, layout_of,
                                scan_token_files, token_counts, tokenizer, word_ids, write_token_files)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tokenizer(open(VOCABULARY, "rb").read())


def test_counts_equal_the_tokenizer(spark, encoder):
    docs = documents(spark, SF001)
    want = {r["doc_id"]: len(encoder.encode_ordinary(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()} == want


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_boundaries_are_stitched_at_any_block_size(spark, docs_frame, encoder, block):
    rows = [(i * 10 ** 12 - 5, "word " * (i * i % 37)) for i in range(40)]
    path = scratch_path(spark, "tokens-test")
    write_token_files(docs_frame(rows).coalesce(2), path)
    got = scan_token_files(spark, path, block=max(block, 5)).collect()
    assert {r["id"]: r["n_tokens"] for r in got} == {k: len(encoder.encode_ordinary(t)) for k, t in rows}
    for f in {r["path"] for r in got}:
        own = sorted((r["document"], r["start"], r["n_tokens"]) for r in got if r["path"] == f)
        assert [x[0] for x in own] == list(range(len(own)))
        assert all(b[1] == a[1] + a[2] + NARROW.id_words + 1 for a, b in zip(own, own[1:]))


def test_files_without_ids(spark):
    """A plain stream with its own separator."""
    path = scratch_path(spark, "tokens-plain")
    words = np.array([5, 6, 9, 9, 7, 9], "<u4")
    own = Layout("<u4", 9, "", 0, 0)
    spark.createDataFrame([(bytearray(words.tobytes()),)], "b binary").selectExpr("cast(b as string) as v").coalesce(1) \
        .write.text(path, lineSep="\x7f" * 4)
    got = sorted((r["start"], r["n_tokens"]) for r in scan_token_files(spark, path, own, ids=False, block=2).collect())
    assert got == [(0, 2), (3, 0), (4, 1)]


def test_edge_cases(docs_frame, encoder, long_text):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (-(1 << 63), "d"), ((1 << 63) - 1, "e"), (7, long_text)]
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts(docs_frame(rows, extra=True)).collect()), key=str)
    assert got == sorted(((k, len(encoder.encode_ordinary(t or ""))) for k, t in rows), key=str)
    assert token_counts(docs_frame([])).collect() == []


def test_ids_never_look_like_the_separator():
    for layout in (NARROW, WIDE):
        keys = [0, 1, -1, layout.separator, (1 << 63) - 1, -(1 << 63), None]
        w = np.array([id_words(k, layout) for k in keys])
        assert (w < 1 << layout.id_bits).all() and 1 << layout.id_bits <= layout.separator
        ids, null = word_ids(w, layout)
        assert [None if n else i for i, n in zip(ids.tolist(), null)] == keys
        assert np.frombuffer(layout.text.encode(), layout.kind).tolist() == [layout.separator]


def test_layout_by_vocabulary(tmp_path, encoder):
    assert layout_of(VOCABULARY) is NARROW and encoder.max_token_value < NARROW.separator
    (tmp_path / "large").write_text("YQ== 1\nYg== 99999\n")
    assert layout_of(str(tmp_path / "large")) is WIDE


@pytest.mark.parametrize("text", ["中文。abc,123;x" * 700, "x" * 50_000, "ab1" * 20_000, "é" * 9000 + " tail"])
def test_long_runs_are_whole(spark, docs_frame, encoder, text):
    """Runs without a blank, of any length, give the tokens of the whole text."""
    (row,) = token_counts(docs_frame([(1, text)])).collect()
    assert row["n_tokens"] == len(encoder.encode_ordinary(text)) == len(encode(encoder, text))
    assert encode(encoder, text).tolist() == encoder.encode_ordinary(text)
