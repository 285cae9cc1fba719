import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators.folds import grouped_folds
from lociq.operators.scoring import METRICS
from lociq.plans import runner as RUN
from lociq.plans.validation import validate_scores
from lociq.session import cut_lineage

CONFIGS = "config_id int, set_type string, set_name string, method string, matrix string, hp map<string,double>"


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"l{i // 4}", int(i % 4 == 0), float(np.round(rng.random(), 2)), [float(v) for v in rng.normal(size=3)]) for i in range(160)]
    return spark.createDataFrame(rows, "case_id int, locus_id string, label int, score double, features array<double>")


def test_runner_equals_direct_validation(spark, cases):
    table = cases.select("case_id", "locus_id", "label")
    scores = cases.select("case_id", "score", F.lit(1).alias("config_id"))
    configs = spark.createDataFrame([(1, "passthrough", "given", "value", None, None)], CONFIGS)
    folds = cut_lineage(grouped_folds(table, 2, 3))
    got, importance = RUN.run_configurations(configs, table, folds, {"value": RUN.given(scores)}, {}, 2, 3)
    want = validate_scores(table, scores, 2, 3, "LOCUS")
    a, b = (df.orderBy("rep", "fold").toPandas() for df in (got, want))
    assert len(a) == 6 and importance is None and got.where("run_time IS NOT NULL").count() == 0
    for role in ("train", "test"):
        for m in METRICS:
            assert np.allclose(a[f"{role}_{m}"].to_numpy(float), b[f"{role}_{m}"].to_numpy(float))


def test_forest_family(spark, cases):
    table = cases.select("case_id", "locus_id", "label")
    configs = spark.createDataFrame([(1, "ranger", "forest", "ranger", "m", {"num_trees": 5.0, "mtry": 2.0, "max_depth": 3.0})], CONFIGS)
    folds = cut_lineage(grouped_folds(table, 1, 2))
    results, importance = RUN.run_configurations(
        configs, table, folds, {"ranger": RUN.forest_of()}, {"m": cases.select("case_id", "features")}, 1, 2
    )
    rows = results.collect()
    assert len(rows) == 2 and all(0 <= r["test_auroc"] <= 1 and r["run_time"] > 0 for r in rows)
    assert importance.count() == 6 and importance.columns[:5] == ["config_id", "set_type", "set_name", "rep", "fold"]
    with pytest.raises(KeyError, match="not registered"):
        RUN.run_configurations(configs, table, folds, {}, {}, 1, 2)


def test_nothing_is_lost_in_joins(spark, cases):
    table = cases.select("case_id", "locus_id", "label")
    configs = spark.createDataFrame([(1, "XGB", "some", "XGB", "m", {"nrounds": 1.0, "max_depth": 1.0})], CONFIGS)
    folds = cut_lineage(grouped_folds(table, 1, 2))
    features = cases.select("case_id", "features")
    run = lambda f, m: RUN.run_configurations(configs, table, f, {"XGB": RUN.boosted(n_bins=4)}, {"m": m}, 1, 2)
    with pytest.raises(ValueError, match="row of folds of replication 1 for 1 cases"):
        run(folds.where("case_id <> 3"), features)
    with pytest.raises(ValueError, match="row of m for 2 cases"):
        run(folds, features.where("case_id > 1"))
    with pytest.raises(ValueError, match="row of m for 1 cases"):
        run(folds, features.union(features.where("case_id = 5")))
    with pytest.raises(ValueError, match="given scores for 1 cases"):
        given = spark.createDataFrame([(1, "passthrough", "given", "value", None, None)], CONFIGS)
        RUN.run_configurations(given, table, folds, {"value": RUN.given(cases.select("case_id", "score").where("case_id <> 9"))}, {}, 1, 2)
    with pytest.raises(ValueError, match="more positives"):
        RUN.run_configurations(configs, table, folds, {}, {}, 1, 40)


def test_nan_scores_count_as_a_half(spark, cases):
    table = cases.select("case_id", "locus_id", "label")
    configs = spark.createDataFrame([(1, "passthrough", "given", "value", None, None)], CONFIGS)
    folds = cut_lineage(grouped_folds(table, 1, 2))
    holes = cases.select("case_id", F.when(F.col("case_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    filled = holes.withColumn("score", F.nanvl("score", F.lit(0.5)))
    a, b = (RUN.run_configurations(configs, table, folds, {"value": RUN.given(s)}, {}, 1, 2)[0].orderBy("fold").toPandas() for s in (holes, filled))
    assert list(a.nan_scores) == [16, 16] and list(b.nan_scores) == [0, 0]
    assert np.allclose(a.test_auroc, b.test_auroc) and np.allclose(a.test_avgrank_neg, b.test_avgrank_neg)
