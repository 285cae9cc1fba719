"""Queries on kept cases: clustered once, joined without a broadcast of what grows with the cases."""

import pytest

import __spark_entry__ as entry
from lociq.operators import folds as FO
from lociq.operators import loci as L
from lociq.operators import metrics as M
from lociq.queries import folds as folds_queries
from lociq.queries import metrics as metrics_queries


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cases(spark):
    rows = [(k, f"{k // 3}", k % 2, float(k % 5)) for k in range(12)]
    return spark.createDataFrame(rows, "case_id long, locus_id string, label int, score double")


@pytest.mark.parametrize("name", ["avgrank_neg", "evaluate_grouped", "within_locus_rank"])
def test_scores_meet_cases_once(spark, cases, monkeypatch, name):
    """F2, F3, F4: one join of cases and values for all branches, and no table of scores or ranks is broadcast."""
    joined = []
    join = metrics_queries.join_large
    monkeypatch.setattr(metrics_queries, "join_large", lambda rows, other, keys: joined.append(other.columns) or join(rows, other, keys))
    monkeypatch.setattr(metrics_queries, "kept", lambda *_: cases)
    monkeypatch.setattr(metrics_queries, "cases", lambda *_: cases.select("case_id", "score"))
    out = entry.queries()[name](spark, "")
    assert joined == [["case_id", "score"]]
    if name == "within_locus_rank":
        assert len(out.collect()) == 36
        assert "Broadcast" not in physical(out)


def test_scores_of_a_repeated_case_meet_all_its_rows(spark, cases, monkeypatch):
    monkeypatch.setattr(metrics_queries, "kept", lambda *_: cases.union(cases))
    monkeypatch.setattr(metrics_queries, "cases", lambda *_: cases.union(cases))
    assert metrics_queries.scored(spark, "").count() == 12 * 2 * 2 * 3


def test_ranks_are_not_broadcast(cases):
    """ranks, a row a case, are merge-joined."""
    out = M.within_locus_rank(cases, ["label"])
    assert len(out.collect()) == 12
    assert "Broadcast" not in physical(out)


@pytest.mark.parametrize("name", ["fold_caps_respected", "fold_profile", "stratified_folds"])
def test_cases_are_clustered_once(spark, cases, monkeypatch, name):
    """the plan reads written cases, however many branches it has."""
    seen = spark.sparkContext.accumulator(0)
    counted = cases.rdd.map(lambda r: seen.add(1) or r).toDF(cases.schema)
    monkeypatch.setattr(folds_queries, "kept", lambda *_: counted)
    entry.queries()[name](spark, "").collect()
    assert seen.value == 12


def test_profile_is_not_broadcast(spark, cases):
    folds = spark.createDataFrame([(k, r, k % 2 + 1) for k in range(12) for r in (1, 2)], "case_id long, rep int, fold int")
    profile = FO.fold_profile(cases, folds)
    assert {tuple(r) for r in profile.collect()} == {(r, f, 6, 6 * (f - 1)) for r in (1, 2) for f in (1, 2)}
    assert "Broadcast" not in physical(profile)


def test_dealt_cases_are_not_broadcast(cases):
    """places of cells come to the cases by a merge join."""
    dealt = FO.stratified_folds(cases, 2, 3)
    assert len(dealt.collect()) == 24
    assert "Broadcast" not in physical(dealt)


def test_positive_loci_with_null_loci_and_labels(spark):
    rows = [(1, "a", 1), (2, "a", 0), (3, "b", 0), (4, "b", None), (5, None, 1), (6, "c", None), (7, "c", 1), (7, "c", 1)]
    df = spark.createDataFrame(rows, "case_id long, locus_id string, label int")
    got = L.keep_positive_loci(df)
    assert sorted(r["case_id"] for r in got.collect()) == [1, 2, 6, 7, 7]
    assert "Broadcast" not in physical(got)
