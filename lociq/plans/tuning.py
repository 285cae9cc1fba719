"""Grid search: every point trained on every fold, averages, and the best points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.analysis import best_configurations
from lociq.plans.runner import boosted, run_configurations
from lociq.plans.validation import results_long
from lociq.session import cut_lineage


@dataclass
class Tuned:
    """Results of each (configuration, rep, fold), and the best point of each set by the two measures."""

    results: DataFrame
    best_aupvr: DataFrame
    best_avgrank: DataFrame


def tune(configs: DataFrame, cases: DataFrame, folds: DataFrame, features: DataFrame, n_rep: int, n_fold: int, n_bins: int = 32, seed: int = 1337) -> Tuned:
    """Train and measure every configuration (config_id, set_type, set_name, hp_no, hp) on one feature table.

    Points with a ``bandwidth`` use the within-locus rank objective, others the logistic one. The best point has
    the largest mean test area under precision-recall, or the smallest mean test rank; the first of equals wins.
    """
    named = configs.withColumn("method", F.lit("XGB")).withColumn("matrix", F.lit("features"))
    results, _ = run_configurations(named, cases, folds, {"XGB": boosted(n_bins, seed)}, {"features": features}, n_rep, n_fold)
    results = cut_lineage(results)
    long = results_long(results, ["set_name", "hp_no", "rep", "fold"])
    return Tuned(results, best_configurations(long, "test_aupvr_dg", True, ["set_name"]), best_configurations(long, "test_avgrank_neg", False, ["set_name"]))
