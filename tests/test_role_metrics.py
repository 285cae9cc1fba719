"""train and test metrics by role, with the counts of all folds side by side."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from lociq.operators import joins
from lociq.operators import metrics as M
from lociq.operators import prefix as P
from lociq.operators import scoring as S
from lociq.queries import metrics as metrics_queries

SCHEMA = "config_id int, rep int, case_id long, locus_id string, label int, score double, fold int"


def values(df):
    return {tuple(r[k] for k in (*S.TASK, "role")): [r[m] for m in S.METRICS] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert [x is None for x in got[key]] == [x is None for x in row], key
        assert np.allclose([x or 0.0 for x in got[key]], [x or 0.0 for x in row], atol=1e-12, rtol=0), key


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, torn loci, repeated cases, a fold of one class, one without labels, and nulls in every column."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        score = [0.5, float(k % 7), float(rng.normal()), -0.0, None, math.nan][k % 6]
        row = [k % 2 + 1, k % 3 // 2 + 1, k // 2, f"l{k % 23}" if k % 3 else "hot", int(rng.integers(0, 2)), score, k % 5 + 1]
        row[4] = {4: 0, 5: None}.get(row[6], row[4] if k % 11 else None)
        if k % 37 == 0:
            row[[0, 1, 3, 6][k // 37 % 4]] = None
        rows += [tuple(row)] * (1 + (k % 13 == 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("heavy", [1_000_000, 1])
def test_side_by_side_equals_the_long_way(odd, monkeypatch, heavy):
    """Also where loci and cells are heavy, and where the scores depend on the fold."""
    members = S.members_by_role(odd, 5)
    members = members.withColumn("score", members.score + members.test_fold * (members.case_id % 3))
    want = values(S.role_metrics(members))
    monkeypatch.setattr(joins, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(P, "HEAVY_CELL", heavy)
    same(values(S.role_metrics(members, n_fold=5)), want)
    assert S.role_metrics(members, n_fold=5).columns == S.role_metrics(members).columns


@pytest.mark.parametrize("n_fold", [1, 40])
def test_any_number_of_folds(odd, n_fold):
    members = S.members_by_role(odd, n_fold)
    same(values(S.role_metrics(members, n_fold=n_fold)), values(S.role_metrics(members)))


def test_a_side_beyond_the_folds_is_an_error(odd):
    with pytest.raises(Exception, match="no side of 4 folds"):
        S.role_metrics(S.members_by_role(odd, 5), n_fold=4).collect()


def test_what_is_shuffled_does_not_grow_with_the_folds(spark):
    """The members of a case are one row before the first exchange."""
    rows = [(1, 1, k, f"l{k // 4}", int(k % 4 == 0), float(k), k % 5 + 1) for k in range(2000)]
    members = S.members_by_role(spark.createDataFrame(rows, SCHEMA).repartition(3), 5)
    written = []

    def walk(node):
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for keys in (["config_id", "rep"], ["config_id", "rep", "locus_id"]):
            points = M.side_points(members, keys, 5, whole="locus_id" in keys)
            assert len(points.collect()) == 2000 * 5
            walk(points._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(written) > 3 and max(written) == 2000, written


def test_the_query_gathers_its_rows_once(spark, monkeypatch):
    """Rows with scores and folds are written once for all passes over the members, and the metrics know the folds."""
    rows = [(k, f"{k // 3}", int(k % 3 == 0), float(k % 5)) for k in range(60)]
    cases = spark.createDataFrame(rows, "case_id long, locus_id string, label int, score double")
    monkeypatch.setattr(metrics_queries, "kept", lambda *_: cases)
    monkeypatch.setattr(metrics_queries, "cases", lambda *_: cases.select("case_id", "score"))
    members = S.members_by_role(metrics_queries.fold_rows(spark, ""), 5)
    assert "Join" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.count() == 60 * 3 * 2 * 5
    want = values(S.role_metrics(members))
    got = {tuple(r[k] for k in (*S.TASK, "role")): [r[m] for m in S.METRICS] for r in entry.queries()["role_metrics"](spark, "").collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 2 * 5 * 2
    assert all(a == pytest.approx(b, abs=1e-6) for k in want for a, b in zip(got[k], want[k], strict=True))
