"""From scores and folds to train and test metrics per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.joins import join_large
from lociq.operators.metrics import MOST_FOLDS, evaluate, evaluate_sides

TASK = ["config_id", "rep", "test_fold"]
METRICS = ["auroc", "aupvr_step", "aupvr_dg", "avgrank_all", "avgrank_neg"]


def check_scores(cases: DataFrame, scores: DataFrame, case: str = "case_id", score: str = "score") -> DataFrame:
    """One row: cases without a score row, score rows without a case, missing scores."""
    joined = cases.select(case, F.lit(1).alias("_c")).join(scores.select(case, score, F.lit(1).alias("_s")), case, "full_outer")

    def tally(cond, name):
        return F.count(F.when(cond, 1)).alias(name)

    both = F.col("_c").isNotNull() & F.col("_s").isNotNull()
    return joined.agg(
        tally(F.col("_s").isNull(), "cases_without_score"),
        tally(F.col("_c").isNull(), "scores_without_case"),
        tally(both & (F.col(score).isNull() | F.isnan(score)), "missing_scores"),
    )


def members_by_role(scored: DataFrame, n_fold: int) -> DataFrame:
    """Every scored case once per test fold, with its role; ``scored`` has ``fold``.

    With one fold nothing is tested: all rows train.
    """
    role = F.when((F.lit(n_fold) > 1) & (F.col("fold") == F.col("test_fold")), "test").otherwise("train")
    return scored.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(n_fold)))).withColumn("role", role)


def given_score_rows(cases: DataFrame, scores: DataFrame, folds: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases with a given score and a fold: one row per (config, rep, case)."""
    return join_large(join_large(cases.drop("score"), scores, [case]), folds, [case])


def repair_nan_scores(df: DataFrame, score: str = "score", value: float = 0.5) -> DataFrame:
    """Replace NaN scores and say how many there were per row (``was_nan``)."""
    return df.withColumn("was_nan", F.isnan(score).cast("int")).withColumn(score, F.nanvl(F.col(score), F.lit(value)))


def role_metrics(
    members: DataFrame, keys: Sequence[str] = TASK, grouped: bool = True, which: Sequence[str] = ("auroc", "aupvr_step", "aupvr_dg"), n_fold: int | None = None
) -> DataFrame:
    """Metrics per (task, role), long form.

    Where ``n_fold`` says how many test folds there are, their rows are counted side by side, so what is shuffled
    and sorted grows with the cases, not with cases x folds. ``members`` are gone through several times.
    """
    if n_fold is None or n_fold > MOST_FOLDS or "test_fold" not in keys:
        return evaluate(members, [*keys, "role"], grouped, which)
    out = evaluate_sides(members, [k for k in keys if k != "test_fold"], n_fold, grouped, which)
    return out.select(*keys, "role", *[c for c in out.columns if c not in (*keys, "role")])


def roles_to_columns(long: DataFrame, keys: Sequence[str] = TASK, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per task with ``train_<metric>`` and ``test_<metric>``; a role that is absent gives NULL."""
    names = metrics or [m for m in METRICS if m in long.columns]
    picked = [
        F.max(F.when(F.col("role") == role, F.col(m))).alias(f"{role}_{m}") for role in ("train", "test") for m in names
    ]
    return long.groupBy(*keys).agg(*picked)

