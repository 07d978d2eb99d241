"""Physical plans and the driver contract on sf0.001."""

import re

import pytest

import __spark_entry__ as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 5 and df.columns == ["user_id", "checkin_count"]


def test_every_query_has_oracle_or_is_model():
    rows_only = {"pca_2d", "tfidf_pca", "word2vec_embed", "random_search", "split_counts", "compare_models"}
    own = {n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n)}  # the others are tested in their folder
    assert own - set(E.oracle_sql()) == rows_only


def test_scan_pruned_and_filter_pushed(spark, sf):
    df = E.q_state_counts_review(spark, sf)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_no_python_udf_in_relational_queries(spark, sf):
    for name in ["text_features", "tfidf_table", "sentiment_lexicon", "hours_total", "combined_left_join"]:
        p = E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_combined_dimension_broadcast(spark, sf):
    p = E.q_combined_left_join(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p


@pytest.mark.parametrize("name", ["checkins_by_weekday", "duplicate_report", "describe_numeric", "tfidf_table",
                                  "doc_mean_vector", "hash_split_counts"])
def test_queries_run_small(spark, sf, name):
    assert E.queries()[name](spark, sf).count() > 0


def _gathers(plan_text):
    """The operator feeding each ``Exchange SinglePartition`` (all rows into one task)."""
    lines = plan_text.splitlines()
    return [lines[i + 1] if i + 1 < len(lines) else "" for i, line in enumerate(lines)
            if "Exchange SinglePartition" in line]


def test_relational_plans_scale(spark, sf):
    """Every oracle-checked query: no cartesian / nested-loop joins, no
    row-at-a-time Python, and nothing data-sized gathered into one task --
    a single-partition exchange only ever receives aggregated rows (a global
    aggregate's partial results, or one count per partition)."""
    qs = E.queries()
    for name in E.oracle_sql():
        p = plan(qs[name](spark, sf))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in p, (name, bad)
        for child in _gathers(p):
            assert "HashAggregate(" in child or "SortAggregate(" in child, (name, child.strip()[:200])


def test_model_queries_run_at_full_settings(spark, sf, monkeypatch):
    """The registered searches and learners get the library's and the reference's settings, not smaller ones."""
    from starlens.fixed_values import RANDOM_SEARCH_SPACE, STUDY_SPACE
    from starlens.plans import rating
    seen = {}
    monkeypatch.setattr(E, "_li_model_frame", lambda spark, d: (None, None, None))
    monkeypatch.setattr(E, "_judged", lambda *a: None)
    monkeypatch.setattr(E.ml, "fit_fm", lambda train, *a, **k: seen.update(fm=k.get("params")))
    monkeypatch.setattr(E, "random_search_cv", lambda train, fit, space, key, **k: seen.update(
        space=space, draws=k["n_iter"]) or (None, None))
    monkeypatch.setattr(E, "compare_models", lambda train, test, params: seen.update(compare=params))

    class Stop(Exception):
        pass

    def study(train, val, fit, space, **k):
        seen.update(study=space, trials=k["n_trials"])
        raise Stop
    monkeypatch.setattr(rating, "assemble_splits", lambda *a: (None, None, None, []))
    monkeypatch.setattr(rating, "cut_lineage", lambda df: df)
    monkeypatch.setattr(rating, "best_of_study", study)
    E.q_fm_fit(spark, sf), E.q_random_search(spark, sf), E.q_compare_models(spark, sf)
    with pytest.raises(Stop):
        E.q_rating_pipeline(spark, sf)
    assert seen["fm"] is None and "fm" not in seen["compare"]
    assert seen["space"] == RANDOM_SEARCH_SPACE and seen["draws"] == 20
    assert seen["study"] == STUDY_SPACE and seen["trials"] == 100
