import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens.llm import infill
from modlens.llm.common import documents
from modlens.llm.infill import Marks, end_marks, fill_in_middle, restored, start_marks, unit_cuts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, len(units), "plain", None, None, text, text
    if h[3] % 100 < 80:
        return key, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return key, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def result(df, **kw):
    out = fill_in_middle(df, **kw).withColumn("back", restored(F.col("output"), F.col("form")))
    return sorted((tuple(r) for r in out.collect()), key=str)


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\n\x0b\x0c\r\x08\x0e\x1f!é中𝄞\x85\xa0 \x89\x8d"), max_size=40), max_size=8))
def test_marks_equal_the_pattern(texts):
    data, offs = packed(texts)
    want = [offs[i] + len(t[:m.end()].encode()) - 1 for i, t in enumerate(texts) for m in UNIT.finditer(t)]
    got = Marks(end_marks(data, offs))
    assert got.select(np.arange(1, got.before[-1] + 1)).tolist() == want
    lead = Marks(start_marks(data))
    assert (lead.rank(offs[1:]) - lead.rank(offs[:-1])).tolist() == [len(t) for t in texts]


def test_every_pair_of_ends():
    text = " a  bc\n\né d "
    units = UNIT.findall(text)
    data, offs = packed([text] * 36)
    h1, h2 = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    n, p, m, pc, mc = unit_cuts(data, offs, h1, h2)
    assert set(n.tolist()) == {len(units)} == {5}
    for i in range(36):
        a, b = sorted((int(h1[i]), int(h2[i])))
        assert bytes(data[offs[i]:p[i]]).decode() == "".join(units[:a]) and pc[i] == len("".join(units[:a]))
        assert bytes(data[p[i]:m[i]]).decode() == "".join(units[a:b]) and mc[i] == len("".join(units[a:b]))


@pytest.mark.parametrize("block", [1, 3, 1 << 15])
def test_blocks_are_stitched(monkeypatch, block):
    texts = ["word " * 50 + "é", "", " ", "x" * 77, "\n" * 9]
    data, offs = packed(texts)
    monkeypatch.setattr(infill, "BLOCK", block)
    got = Marks(end_marks(data, offs))
    assert (got.rank(offs[1:]) - got.rank(offs[:-1])).tolist() == [len(UNIT.findall(t)) for t in texts]


def test_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((brute(*r) for r in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert result(docs) == want


def test_edge_cases(spark, docs_frame, long_text):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "\n\t ", "a", " a ", "<P>x y z", "a <S> b", "x<M>", "é 中 𝄞",
                                          "< P > <", "<S", "S> <M", "a\x00b c"])]
    rows += [(i + 100, f"tie <{'PSM'[i % 3]} a>b <") for i in range(60)]
    rows += [(5, "a"), (5, "a"), (None, "no id here"), (7, long_text), (8, "x" * 3_000_000)]
    got = result(docs_frame(rows, extra=True))
    assert got == sorted((brute(*r) for r in rows), key=str)


def test_rates_seed_and_empty_table(spark, docs_frame):
    rows = [(i, f"one two three {i}") for i in range(50)]
    assert {r[2] for r in result(docs_frame(rows), rate=100, spm_rate=0)} == {"psm"}
    assert {r[2] for r in result(docs_frame(rows), rate=0)} == {"plain"}
    assert result(docs_frame(rows), seed="1") != result(docs_frame(rows))
    assert result(docs_frame([])) == []


def test_plan_has_no_exchange(spark):
    plan = fill_in_middle(documents(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
