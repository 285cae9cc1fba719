"""End-to-end plans: cases to loci, folds, scores, metrics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lociq.operators.analysis import average_results, to_long
from lociq.operators.folds import assign_folds
from lociq.operators.loci import DEFAULT_CUTOFF, assign_loci, keep_positive_loci
from lociq.operators.metrics import evaluate_folds, require_whole_loci
from lociq.operators.scoring import given_score_rows, roles_to_columns
from lociq.session import cut_lineage


def clustered_cases(cases: DataFrame, cutoff: int = DEFAULT_CUTOFF, on_missing: str = "drop") -> DataFrame:
    """Cases with locus ids; loci without a positive are dealt with as asked."""
    return keep_positive_loci(assign_loci(cases, cutoff=cutoff), on_missing=on_missing)


def validate_scores(
    cases: DataFrame,
    scores: DataFrame,
    n_rep: int,
    n_fold: int,
    method: str = "LOCUS",
    materialize: bool = True,
    **fold_options,
) -> DataFrame:
    """Train and test metrics per (config, rep, fold) of given scores.

    Ranks within loci are given with ``LOCUS`` folds only, where every locus is
    evaluated as a whole, which is checked; with the other methods there are areas only.
    Both inputs of several branches, the clustered cases and the scored rows,
    are written once (reliable checkpoint) unless ``materialize`` is off.
    """
    keep = cut_lineage if materialize else (lambda df: df)
    cases = keep(cases)
    folds = assign_folds(cases, method, n_rep, n_fold, **fold_options)
    rows = keep(given_score_rows(cases, scores, folds))
    grouped = method == "LOCUS"
    if grouped:
        require_whole_loci(rows, ["config_id", "rep"])
    results = roles_to_columns(evaluate_folds(rows, ["config_id", "rep"], n_fold, grouped))
    return results.withColumnRenamed("test_fold", "fold")


def results_long(results: DataFrame, keys: Sequence[str] = ("config_id", "rep", "fold")) -> DataFrame:
    """Results as (keys, metric, value) rows."""
    metrics = [c for c in results.columns if c.startswith(("train_", "test_"))]
    return to_long(results, keys, metrics)


def score_summary(results: DataFrame) -> DataFrame:
    """Average per configuration and metric."""
    return average_results(results_long(results))


def partition_by_set(results: DataFrame, configs: DataFrame) -> DataFrame:
    """Results with the set type and name of their configuration."""
    return results.join(configs.select("config_id", "set_type", "set_name"), "config_id")
