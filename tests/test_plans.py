"""Physical-plan checks: the plans we want, not just the right rows."""

from modlens.plans import catalog as C

from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lexicon_score_is_map_only_with_hash_set(spark):
    df = C.QUERIES["lex_score"](spark, SF01)
    opt = _optimized(df)
    assert "INSET" in opt.upper() or "InSet" in opt
    plan = _plan(df)
    for slow in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert slow not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_one_scan_of_the_documents(spark):
    """The lexicon pass over the corpus runs once per query; other scans read ids only."""
    for key in ("set_union_tagged", "agg_multilabel_onehot", "join_left_categories", "eval_epoch_batch_mean", "prep_annotations",
                "flagship_compare"):
        plan = _plan(C.QUERIES[key](spark, SF01)).split("== Initial Plan ==")[0]
        assert plan.count("text:string") == 1, key


def test_scan_prunes_columns(spark):
    df = C.QUERIES["prj_label_from_string"](spark, SF01)
    s = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in s and "value" not in s


def test_samples_use_group_limit(spark):
    df = C.QUERIES["err_confusion_samples"](spark, SF01)
    assert "WindowGroupLimit" in _plan(df)


def test_no_python_in_sql_expressible_queries(spark):
    for key in ("flagship_compare", "smp_stratified_split", "prep_annotations", "agg_kde_grid",
                "txt_truncation_profile", "smp_balanced_resample"):
        plan = _plan(C.QUERIES[key](spark, SF01))
        assert "EvalPython" not in plan and "MapInPandas" not in plan, key


def test_no_cross_joins(spark):
    for key, fn in C.QUERIES.items():
        if key.startswith(("src_", "snk_")):
            continue
        plan = _plan(fn(spark, SF01))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
