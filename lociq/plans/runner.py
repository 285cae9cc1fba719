"""Run all configurations on all replications and folds.

Configurations that share a method and a feature table are scored together;
their tasks are rows. Features are kept once for each case (or, with a reducer, once for each case and
training set), and members say which role a case has in which task. A scorer is a callable
``(rows, members, tasks) -> scored``: rows hold variant, case_id, locus_id, label, features; members hold task_id,
variant, case_id, role; tasks hold task_id and hp; the result has task_id, case_id, locus_id, role, label, score.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators import boost, forest
from lociq.operators.folds import fold_count_feasible
from lociq.operators.joins import join_large, join_small
from lociq.operators.metrics import require_whole_loci
from lociq.operators.quality import require_complete, require_rows
from lociq.operators.reduce import pls_scores
from lociq.operators.scoring import members_by_role, repair_nan_scores, role_metrics, roles_to_columns
from lociq.operators.tasks import resolve, task_table, write_back
from lociq.session import cut_lineage

Scorer = Callable[[DataFrame, DataFrame, DataFrame], "Scored"]
KEY = ["variant", "case_id"]
SCORED = ["task_id", "case_id", "locus_id", "role", "label"]
IMPORTANCE = ["feature", "importance", "cover", "frequency"]


@dataclass
class Scored:
    """Scores of one family of tasks, its feature importance (task_id and ``IMPORTANCE``) if any, and its training time in seconds."""

    scores: DataFrame
    importance: DataFrame | None = None
    seconds: float | None = None


def given(scores: DataFrame) -> Scorer:
    """Use one given score per case; a case without a score is an error."""

    def score(rows: DataFrame, members: DataFrame, tasks: DataFrame) -> Scored:
        require_rows(rows, {"given scores": scores})
        cases = join_large(rows.select(*KEY, "locus_id", "label"), scores.select("case_id", "score"), ["case_id"])
        return Scored(members.join(cases, KEY).select(*SCORED, "score"))

    return score


def boosted(n_bins: int = 32, seed: int = 1337, objective: boost.Objective | None = None) -> Scorer:
    """Second-order boosting of all tasks together.

    Cut points are exact quantiles of the feature table as a whole. Tasks whose parameters have a
    ``bandwidth`` are trained with the within-locus rank objective, the others with the logistic one; ``objective`` replaces both.
    """

    def score(rows: DataFrame, members: DataFrame, tasks: DataFrame) -> Scored:
        started = time.time()
        rows = cut_lineage(rows)
        width = rows.select(F.max(F.size("features"))).first()[0] or 0
        cuts = boost.quantile_cuts(rows, width, n_bins)
        out = boost.newton_boost(boost.binned(rows, cuts), members, boost.task_settings(tasks), cuts, seed, objective, KEY)
        found = boost.split_importance(out.splits).withColumnRenamed("gain", "importance")
        return Scored(out.scores.select(*SCORED, "score"), found, time.time() - started)

    return score


def forest_of(votes: bool = True, seed: int = 1337) -> Scorer:
    """Random forest, one fit per task: for few, large tasks. Missing features are an error."""

    def score(rows: DataFrame, members: DataFrame, tasks: DataFrame) -> Scored:
        started, scores, tables = time.time(), None, None
        require_complete(rows.select(F.explode("features").alias("value")))
        for task in tasks.select("task_id", "hp").collect():
            mine = rows.join(members.where(F.col("task_id") == task["task_id"]), KEY)
            mine, found = forest.forest_scores(mine, task["hp"] or {}, seed, votes=votes)
            none = [F.lit(None).cast("double").alias(c) for c in ("cover", "frequency")]
            mine, found = mine.select(*SCORED, "score"), found.select(F.lit(task["task_id"]).alias("task_id"), "feature", "importance", *none)
            scores = mine if scores is None else scores.unionByName(mine)
            tables = found if tables is None else tables.unionByName(found)
        return Scored(scores, tables, time.time() - started)

    return score


def task_members(folds: DataFrame, tasks: DataFrame, n_fold: int, by_fold: bool = False) -> DataFrame:
    """(task_id, variant, case_id, role): every case once per task; the variant is the fold number if rows differ by training set, else 0."""
    sides = members_by_role(folds.select("case_id", "rep", "fold"), n_fold)
    # One row per (rep, fold) with its tasks, as many as there are configurations.
    slots = tasks.groupBy("rep", F.col("fold").alias("test_fold")).agg(F.collect_list("task_id").alias("_tasks"))
    variant = (F.col("rep") - 1) * n_fold + F.col("test_fold") if by_fold else F.lit(0)
    return join_small(sides, slots, ["rep", "test_fold"]).select(F.explode("_tasks").alias("task_id"), variant.cast("int").alias("variant"), "case_id", "role")


def with_reduced(rows: DataFrame, extra: DataFrame, folds: DataFrame, n_fold: int, n_components: int) -> DataFrame:
    """Rows for each training set, with components fitted on its cases from a second feature table appended to the features."""
    sides = members_by_role(rows.select("case_id", "label").join(folds.select("case_id", "rep", "fold"), "case_id"), n_fold)
    sides = sides.withColumn("variant", ((F.col("rep") - 1) * n_fold + F.col("test_fold")).cast("int"))
    reduced = pls_scores(sides.join(extra, "case_id"), n_components, ["variant"])
    joined = rows.drop("variant").join(reduced.select("variant", "case_id", "pls"), "case_id")
    return joined.withColumn("features", F.concat("features", "pls")).drop("pls")


def run_configurations(
    configs: DataFrame,
    cases: DataFrame,
    folds: DataFrame,
    scorers: Mapping[str, Scorer],
    matrices: Mapping[str, DataFrame],
    n_rep: int,
    n_fold: int,
    grouped: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """(results per task, importance per task and feature or None).

    ``configs`` has config_id, set_type, set_name, method, matrix, hp and
    optionally reducer_matrix and reducer_components. Results carry the
    configuration's identifiers, train and test metrics, the number of NaN scores that were replaced by 0.5, and the run time of
    the family the task was trained in (NULL for given scores). Importance is one long
    table (config_id, set_type, set_name, rep, fold, feature, importance, cover, frequency).

    Nothing is lost in joins: a case without a fold or a feature row is an error, as are as many folds as
    positives. With ``grouped``, folds that tear a locus are an error, as ranks inside it would miss members.
    """
    if grouped:
        require_whole_loci(cases.select("case_id", "locus_id").join(folds, "case_id"), ["rep"])
    if n_fold > 1 and not fold_count_feasible(cases, n_fold).first()["feasible"]:
        raise ValueError(f"{n_fold} folds need more positives than that")
    tasks = cut_lineage(task_table(configs, n_rep, n_fold))
    shape = ["method", "matrix"] + [c for c in ("reducer_matrix", "reducer_components") if c in configs.columns]
    families = configs.select(*shape).distinct().collect()
    names = {f[c] for f in families for c in ("matrix", "reducer_matrix") if c in shape and f[c] is not None}
    in_reps = {f"folds of replication {r}": folds.where(F.col("rep") == r) for r in range(1, n_rep + 1)}
    require_rows(cases, in_reps | {n: resolve(matrices, n) for n in sorted(names)})
    scored, times, importances = [], [], []
    for family in families:
        scorer = resolve(scorers, family["method"])
        same = [F.col(c).eqNullSafe(F.lit(family[c])) for c in shape]
        mine = tasks.where(reduce(lambda a, b: a & b, same))
        rows = cases.select("case_id", "locus_id", "label").withColumn("variant", F.lit(0))
        if family["matrix"] is not None:
            rows = rows.join(resolve(matrices, family["matrix"]).select("case_id", "features"), "case_id")
        by_fold = len(shape) > 2 and family["reducer_matrix"] is not None
        if by_fold:
            rows = with_reduced(rows, resolve(matrices, family["reducer_matrix"]).select("case_id", "features"), folds, n_fold, int(family["reducer_components"]))
        done = scorer(rows, task_members(folds, mine, n_fold, by_fold), mine)
        scored.append(cut_lineage(done.scores))
        times.append(mine.select("task_id", F.lit(done.seconds).cast("double").alias("run_time")))
        if done.importance is not None:
            importances.append(done.importance.select("task_id", F.col("feature").cast("long").alias("feature"), *IMPORTANCE[1:]))
    every = repair_nan_scores(reduce(DataFrame.unionByName, scored))
    measured = roles_to_columns(role_metrics(every, ["task_id"], grouped), ["task_id"])
    repaired = every.groupBy("task_id").agg(F.sum("was_nan").alias("nan_scores"))
    results = write_back(tasks, measured.join(repaired, "task_id").join(reduce(DataFrame.unionByName, times), "task_id"))
    if not importances:
        return results, None
    listed = tasks.select("task_id", "config_id", "set_type", "set_name", "rep", "fold")
    return results, reduce(DataFrame.unionByName, importances).join(listed, "task_id").select("config_id", "set_type", "set_name", "rep", "fold", *IMPORTANCE)
