import pytest

import corpus_pipeline as cp
from modlens.llm.common import documents
from modlens.llm.decontaminate import contaminated
from modlens.llm.jaccard import jaccard_components
from modlens.llm.langid import predict, profiles
from modlens.llm.mixing import mix
from modlens.llm.pii import base_spans

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF001), []
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF001), f"test-{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for s in stages[:-1]:
        assert s.dtypes == documents(spark, SF001).dtypes


def test_decisions_take_effect(spark, stages):
    docs = documents(spark, SF001)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    found = predict(docs, profiles(docs), drop_text=True)
    assert ids(stages[0]) == ids(found.where(f"lang_pred != 'und' and score >= {cp.MIN_LANGUAGE_SCORE}"))
    assert ids(stages[1]) == ids(jaccard_components(stages[0]).where("doc_id = component_id"))
    leaks = {r["doc_id"] for r in contaminated(stages[1], documents(spark, SF001, "benchmark")).collect()}
    assert ids(stages[2]) == [i for i in ids(stages[1]) if i not in leaks] and leaks
    assert ids(stages[3]) == ids(stages[2])
    assert all(base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"]) for r in stages[3].collect())
    assert ids(stages[4]) == ids(stages[3])
    assert sorted(map(tuple, stages[4].select("doc_id", "taken").collect())) == sorted(
        map(tuple, mix(stages[3]).select("doc_id", "taken").collect()))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF001).select("doc_id", "taken").collect())) == sorted(
        map(tuple, stages[-1].select("doc_id", "taken").collect()))


def test_edge_rows(spark, docs_frame):
    text = "the house of the man and the old tree by the river"
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text + " again"), (5, "1234 !!")]
    df = docs_frame(rows, extra=True)
    kept = cp.language(spark, df, SF001)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 2]
    one = cp.near_duplicates(spark, kept, SF001)
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1]
    twice = cp.near_duplicates(spark, docs_frame([(1, text), (1, text)]), SF001)
    assert twice.count() == 1
    empty = docs_frame([])
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF001).count() == 0


def test_texts_under_one_id_are_decided_one_by_one(spark, docs_frame):
    base = " ".join(f"a{i}" for i in range(60))
    other, clean = " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, clean), (5, clean), (6, other), (6, other + " more"), (6, None), (None, base)]
    got = cp.near_duplicates(spark, docs_frame(rows, extra=True), SF001).collect()
    assert len(got) == 5 and {(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 6} == {(1, base), (5, clean), (None, base)}
    assert sorted(r["text"] is None for r in got if r["doc_id"] == 6) == [False, True]
