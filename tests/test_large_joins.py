"""Joins of tables that grow with the cases: what is broadcast and what is repeated."""

import numpy as np

from lociq.functions.draws import uniform_py
from lociq.operators import folds as FO
from lociq.operators import joins
from lociq.operators import loci as L
from lociq.operators import scoring as S
from lociq.queries import metrics
from lociq.sources.fixtures import given_scores


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_and_folds_are_never_broadcast(spark):
    cases = spark.createDataFrame([(k, f"{k // 3}", 1, float(k % 5)) for k in range(12)], "case_id long, locus_id string, label int, score double")
    folds = spark.createDataFrame([(k, r, k % 2 + 1) for k in range(12) for r in (1, 2)], "case_id long, rep int, fold int")
    rows = S.given_score_rows(cases, given_scores(cases), folds)
    assert rows.count() == 12 * 3 * 2
    assert "Broadcast" not in physical(rows)


def test_scored_cases_are_never_broadcast(spark, monkeypatch):
    cases = spark.createDataFrame([(k, f"{k // 3}", 1, float(k % 5)) for k in range(12)], "case_id long, locus_id string, label int, score double")
    monkeypatch.setattr(metrics, "kept", lambda *_: cases)
    monkeypatch.setattr(metrics, "cases", lambda *_: cases)
    rows = metrics.scored(spark, "").select("config_id")
    assert rows.count() == 12 * 3
    assert "Broadcast" not in physical(rows)


def test_only_heavy_blocks_are_repeated(spark, monkeypatch):
    rows = [(k, f"{k % 4}", (k // 4) * 40) for k in range(80)] + [(100 + k, "hot", 7) for k in range(30)]
    df = spark.createDataFrame(rows, "case_id long, chrom string, coord long")
    want = {r[0]: r[1] for r in L.assign_loci(df, cutoff=30).select("case_id", "locus_id").collect()}
    monkeypatch.setattr(joins, "BROADCAST_VALUES", 0)
    light = L.assign_loci(df, cutoff=30)
    assert {r[0]: r[1] for r in light.select("case_id", "locus_id").collect()} == want
    assert "Generate" not in physical(light)
    monkeypatch.setattr(joins, "HEAVY_ROWS", 20)
    heavy = L.assign_loci(df, cutoff=30)
    assert {r[0]: r[1] for r in heavy.select("case_id", "locus_id").collect()} == want
    assert "Generate" in physical(heavy)


def test_every_locus_is_walked_as_before(spark):
    """Drawing by itself gives what drawing with arrays of weights gave, and the plan of a row a locus is not broadcast."""
    loci = spark.createDataFrame([(f"l{k}", k % 4 + 1, k % 3 % (k % 4 + 2)) for k in range(300)], "locus_id string, cases long, positives long")
    dealt = FO.locus_folds(loci, 1, 3)
    got = [r["fold"] for r in dealt.orderBy("locus_id").collect()]
    assert "Broadcast" not in physical(dealt)
    shapes = loci.groupBy("cases", "positives").count().withColumnRenamed("count", "loci").selectExpr("1 AS rep", "*").toPandas()
    plan = FO._dealer(3, 0.5, 1337, 1)(shapes)
    used, drawn = np.zeros((2, 3)), 0
    n, p = (shapes["cases"] * shapes["loci"]).sum(), (shapes["positives"] * shapes["loci"]).sum()
    most = np.ceil(1.5 * n / 3)
    most = most, np.ceil(1.5 * most * p / n)
    for size, positives, upto in zip(plan["cases"], plan["positives"], plan["upto"], strict=True):
        drawn += 1
        weights = np.where((used[0] + size <= most[0]) & (used[1] + positives <= most[1]), (1 - used[0] / most[0]) * (1 - used[1] / most[1]), 0.0)
        pick = int((weights.cumsum() <= uniform_py(1337, 1, "draw", drawn) * weights.sum()).sum())
        assert list(upto) == [int(k >= pick) for k in range(3)]
        used[:, pick] += (size, positives)
    assert len(got) == 300 and set(got) == {1, 2, 3}


def test_few_rows_are_looked_up_by_marks(spark):
    """Nulls, repeated keys and names that clash: the results of the plain joins, and few rows reach the shuffle."""
    rows = [(k if k % 50 else None, f"t{k}", k % 7, 1) for k in range(20_000)] + [(17, "again", 0, 0), (-5, "below", 0, 0)]
    wide = spark.createDataFrame(rows, "id long, text string, _marks int, _MARKSpart int")
    ids = spark.createDataFrame([(k,) for k in [*range(3, 20_000, 1000), 17, 17, -5, 10**12, None]], "id long").checkpoint()
    for found, how in ((joins.with_ids, "left_semi"), (joins.without_ids, "left_anti")):
        got, want = found(wide, ids, "id"), wide.join(ids, "id", how)
        assert got.columns == wide.columns and sorted(map(str, got.collect())) == sorted(map(str, want.select(*wide.columns).collect()))
        none = found(wide, ids.where("false").checkpoint(), "id")
        assert none.count() == (0 if how == "left_semi" else len(rows))
    marked, name = joins._marked(wide, ids, "id")
    assert marked.where(name).count() < 100


def test_marks_are_bounded(spark, monkeypatch):
    """Where keys are more than the marks can tell, more rows are looked up and none is lost."""
    wide, ids = spark.range(100_000).selectExpr("id", "'x' AS text"), spark.range(0, 100_000, 3).checkpoint()
    monkeypatch.setattr(joins, "MOST_MARKS", 40_000)
    assert joins.with_ids(wide, ids, "id").count() == ids.count()
    assert joins.without_ids(wide, ids, "id").count() == 100_000 - ids.count()
