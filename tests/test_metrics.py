import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lociq.functions.scalars import logit_mean, order_code, reciprocal_span
from lociq.functions.student import incomplete_beta
from lociq.operators import analysis as A
from lociq.operators import metrics as M
from lociq.operators import prefix as P
from lociq.operators import scoring as S

FOUR = [(1, "a", 1, 0.9), (2, "a", 0, 0.8), (3, "a", 1, 0.8), (4, "a", 0, 0.1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id int, locus_id string, label int, score double").withColumn("t", F.lit(1))


def test_hand_computed_values(spark):
    row = M.evaluate(frame(spark, FOUR), ["t"]).first()
    assert row["auroc"] == pytest.approx(0.875)
    assert row["aupvr_step"] == pytest.approx((1 + 2 / 3) / 2)
    assert row["avgrank_all"] == pytest.approx(1.75)
    assert row["avgrank_neg"] == pytest.approx(1.25)


def test_one_class_has_no_area(spark):
    row = M.evaluate(frame(spark, [(1, "a", 0, 0.5), (2, "a", 0, 0.1)]), ["t"]).first()
    assert row["auroc"] is None and row["aupvr_dg"] is None and row["avgrank_all"] is None


def plain_dg(labels, scores):
    """Interpolated area, one positive at a time."""
    area, tp, fp, pos = 0.0, 0, 0, sum(labels)
    for s in sorted(set(scores), reverse=True):
        p = sum(1 for y, x in zip(labels, scores) if x == s and y == 1)
        n = sum(1 for y, x in zip(labels, scores) if x == s and y == 0)
        for x in range(1, p + 1):
            hi = (tp + x) / (tp + x + fp + n * x / p)
            lo_den = tp + x - 1 + fp + n * (x - 1) / p
            lo = (tp + x - 1) / lo_den if lo_den > 0 else p / (p + n)
            area += (hi + lo) / 2 / pos
        tp, fp = tp + p, fp + n
    return area


@pytest.fixture(scope="module")
def random_frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # A third of the rows share one score, a third one locus; negative, zero and tiny scores occur.
    scores = np.where(rng.random(n) < 0.33, 0.25, np.round(rng.normal(size=n), 2) * 10.0 ** rng.integers(-9, 3, n))
    pdf = pd.DataFrame(
        {
            "case_id": range(n),
            "locus_id": np.where(rng.random(n) < 0.33, "hot", [f"l{i}" for i in rng.integers(0, 300, n)]),
            "label": rng.integers(0, 2, n),
            "score": scores,
            "fold": rng.integers(1, 4, n),
            "t": 1,
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_random_scores_against_plain_loops(spark, random_frame):
    pdf, df = random_frame
    row = M.evaluate(df, ["t"]).first()
    pos, neg = pdf.score[pdf.label == 1].to_numpy(), pdf.score[pdf.label == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert row["auroc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    assert row["aupvr_dg"] == pytest.approx(plain_dg(pdf.label.tolist(), pdf.score.tolist()), abs=1e-11)
    ranks = pdf.groupby("locus_id").score.rank(ascending=False, method="average")
    assert row["avgrank_all"] == pytest.approx(ranks[pdf.label == 1].mean(), abs=1e-12)
    got = M.within_locus_rank(df, ["t"]).toPandas().set_index("case_id").locus_rank.sort_index()
    assert np.allclose(got.to_numpy(), ranks.to_numpy())


def test_auroc_equals_spark_evaluator(spark, random_frame):
    _, df = random_frame
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert M.auroc(df, ["t"]).first()["auroc"] == pytest.approx(evaluator.evaluate(df.withColumn("score", F.col("score"))), abs=1e-9)


def test_fold_points_equal_the_long_way(spark, random_frame):
    _, df = random_frame
    long = S.role_metrics(S.members_by_role(df, 3), ["t", "test_fold"]).toPandas().sort_values(["test_fold", "role"])
    short = M.evaluate_folds(df, ["t"], 3).toPandas().sort_values(["test_fold", "role"])
    for c in S.METRICS:
        assert np.allclose(long[c].to_numpy(float), short[c].to_numpy(float))


def test_locus_gaps(spark):
    df = frame(spark, FOUR)
    assert M.locus_gaps(df.where("case_id < 4"), df, ["t"]).first()["members"] == 4
    assert M.locus_gaps(df, df, ["t"]).count() == 0


def test_order_code_keeps_the_order(spark):
    values = [-math.inf, -1e300, -2.0, -1.9, -1e-300, 0.0, 5e-324, 1e-9, 0.5, 0.50001, 1.0, 3.0, 1e308, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    cells = [r["c"] for r in rows.select("i", order_code("v").alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells) and None not in cells


@pytest.mark.parametrize("z", [0.0, 0.3, 8.0, 1e4, 1e9])
@pytest.mark.parametrize("p", [1, 32, 33, 2000])
def test_reciprocal_span(spark, z, p):
    want = math.fsum(1 / (z + x) for x in range(1, p + 1))
    got = spark.range(1).select(F.expr(reciprocal_span(f"{z!r}D", f"CAST({p} AS DOUBLE)")).alias("s")).first()["s"]
    assert got == pytest.approx(want, rel=1e-12)


def test_student_tail():
    # df 1: arctangent; df 2: closed form.
    for t in (0.1, 1.0, 5.0, 40.0):
        assert incomplete_beta(0.5, 0.5, 1 / (1 + t * t)) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert incomplete_beta(1.0, 0.5, 2 / (2 + t * t)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert 0 < incomplete_beta(500.0, 0.5, 1000 / (1000 + 900.0)) < 1e-60


def long_rows(spark, values):
    return spark.createDataFrame([(c, r, f, m, v) for c, r, f, m, v in values], "config_id int, rep int, fold int, metric string, value double")


def test_logit_mean_and_extremes(spark):
    df = spark.createDataFrame([(0.2,), (0.8,)], "x double")
    assert df.agg(logit_mean("x")).first()[0] == pytest.approx(0.5)
    one = spark.createDataFrame([(0.5,), (1.0,)], "x double")
    assert one.agg(logit_mean("x")).first()[0] == 1.0
    with pytest.raises(Exception, match="logit of 1.5"):
        spark.createDataFrame([(1.5,)], "x double").agg(logit_mean("x")).collect()


def test_missing_values_are_counted_and_block_the_t_test(spark):
    rows = [(1, 1, f, "test_aupvr", 0.5 + f / 10) for f in range(1, 4)] + [(2, 1, f, "test_aupvr", None if f == 2 else 0.4) for f in range(1, 4)]
    long = long_rows(spark, rows)
    averages = {r["config_id"]: r for r in A.average_results(long).collect()}
    assert averages[2]["n_missing"] == 1 and averages[2]["average"] == pytest.approx(0.4)
    best = spark.createDataFrame([(1,)], "config_id int")
    assert A.with_p_value(A.paired_t(long, best)).first()["pvalue"] is None


def test_a_fold_without_a_partner_blocks_the_t_test(spark):
    best = spark.createDataFrame([(1,)], "config_id int")
    full = [(c, 1, f, "test_aupvr", 0.3 + f / 10 + c / 100 * f) for c in (1, 2, 3) for f in range(1, 5)]
    for drop in ((1, 1, 2), (2, 1, 2)):
        long = long_rows(spark, [r for r in full if r[:3] != drop])
        t = {r["config_id"]: r["t"] for r in A.paired_t(long, best).collect()}
        assert t[2] is None and (t[3] is None) == (drop[0] == 1)


def test_first_configuration_wins_a_tie(spark):
    rows = [(c, 1, 1, "test_aupvr", 0.5) for c in (3, 1, 2)]
    long = long_rows(spark, rows).withColumnRenamed("config_id", "hp_no").withColumn("method", F.lit("m"))
    assert A.best_configurations(long, "test_aupvr", largest=True).first()["hp_no"] == 1


def test_selection_is_a_substring_test(spark):
    rows = spark.createDataFrame([(1, "s", "scale_pos_weight=14.45"), (2, "s", "scale_pos_weight=8.0"), (3, "o", "x=1")], "config_id int, set_name string, hp_text string")
    assert sorted(r["config_id"] for r in A.plot_selection(rows, ["s"]).collect()) == [1, 3]


def test_nan_scores_are_replaced_and_counted(spark):
    df = spark.createDataFrame([(float("nan"),), (0.2,)], "score double")
    assert [(r["score"], r["was_nan"]) for r in S.repair_nan_scores(df).collect()] == [(0.5, 1), (0.2, 0)]


def test_torn_loci_have_no_ranks(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 1)], "task int, locus_id string, fold int")
    with pytest.raises(ValueError, match="whole loci"):
        M.require_whole_loci(rows, ["task"])
    M.require_whole_loci(rows.where("fold = 1"), ["task"])


def scattered(n):
    """A million and tiny differences, numbers of all sizes, and a few at one place."""
    return [1e6 + k * 1e-7 for k in range(n)] + [10.0 ** (k * 600 / n - 300) * (-1) ** k for k in range(n)] + [0.0, 5.0, -5.0]


@pytest.mark.parametrize("heavy", [50, 1_000_000])
def test_score_cells_are_small_and_in_order(spark, monkeypatch, heavy):
    monkeypatch.setattr(P, "HEAVY_CELL", heavy)
    n = 3_000
    df = spark.createDataFrame([(t, x) for t in (1, 2) for x in scattered(n)], "t int, score double")
    got = P.score_cells(df, ["t"], P.heavy_cells(df, ["t"])).orderBy("t", "score").toPandas()
    assert len(got) == len(df.toPandas())
    for _, one in got.groupby("t"):
        cells = one[P.CELL].to_list()
        assert cells == sorted(cells)
        near = one[(one.score >= 1e6) & (one.score < 1e6 + 1)]
        if heavy == 50:
            assert one.groupby(P.CELL).size().max() <= 50 and near[P.CELL].nunique() > 100
        else:
            assert near[P.CELL].nunique() == 1


def test_metrics_do_not_depend_on_the_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.array(scattered(400))
    pdf = pd.DataFrame({"case_id": range(len(x)), "locus_id": np.where(rng.random(len(x)) < 0.5, "hot", "l"), "label": rng.integers(0, 2, len(x)), "score": x, "t": 1})
    df = spark.createDataFrame(pdf)
    want = M.evaluate(df, ["t"]).first()
    monkeypatch.setattr(P, "HEAVY_CELL", 5)
    got = M.evaluate(df, ["t"]).first()
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(got, want, strict=True))


def test_resamples_in_blocks_of_any_size(spark, monkeypatch):
    rows = [(c, 1, f, m, 0.1 * f + 0.05 * c) for c in (1, 2) for f in range(1, 8) for m in ("test_aupvr", "test_avgrank")] + [(1, 1, 9, "test_avgrank", 3.0)]
    long = long_rows(spark, rows)
    want = sorted(map(tuple, A.bootstrap_means(long, 23).collect()))
    assert len(want) == 2 * 2 * 23
    monkeypatch.setattr(A, "BLOCK", 7)
    assert sorted(map(tuple, A.bootstrap_means(long, 23).collect())) == want
