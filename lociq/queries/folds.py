"""Fold assignment and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.operators import folds as FO
from lociq.queries import query
from lociq.queries.loci import kept
from lociq.queries.sql import CAPS, FOLD_NOS, GROUPED, KEPT, N_FOLD, N_REP, REPS, shuffled
from lociq.session import cut_lineage


def written(spark, folder):
    """Kept cases for queries with several branches: clustered once and written, not once a branch."""
    return cut_lineage(kept(spark, folder).select("case_id", "locus_id", "label"))


@query("fold_caps", f"WITH {KEPT} {CAPS}")
def _(spark, folder):
    return FO.fold_caps(kept(spark, folder), N_FOLD)


@query(
    "fold_count_feasible",
    f"""WITH {KEPT} SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
    {N_FOLD} < count(*) / (sum(1 - label) / sum(label) + 1) AS feasible FROM kept""",
)
def _(spark, folder):
    return FO.fold_count_feasible(kept(spark, folder), N_FOLD)


@query("replications", f"WITH {KEPT}{REPS} SELECT case_id, rep FROM kept, reps")
def _(spark, folder):
    return FO.with_replications(kept(spark, folder).select("case_id"), N_REP)


@query("shuffled_folds", f"WITH {shuffled()} SELECT case_id, rep, fold FROM folds")
def _(spark, folder):
    return FO.assign_folds(written(spark, folder), "SNP", N_REP, N_FOLD)


@query("stratified_folds", f"WITH {shuffled('label')} SELECT case_id, rep, fold FROM folds")
def _(spark, folder):
    return FO.assign_folds(written(spark, folder), "STRATIFIED", N_REP, N_FOLD)


@query("grouped_folds", f"WITH RECURSIVE {GROUPED} SELECT case_id, rep, fold FROM grouped")
def _(spark, folder):
    return FO.assign_folds(written(spark, folder), "LOCUS", N_REP, N_FOLD)


@query(
    "fold_table",
    f"""WITH {shuffled()}{FOLD_NOS} SELECT rep, (rep - 1) * {N_FOLD} + test_fold AS fold_index, test_fold, case_id,
    CASE WHEN fold = test_fold THEN 'test' ELSE 'train' END AS role FROM folds, fold_nos""",
)
def _(spark, folder):
    return FO.fold_table(FO.shuffled_folds(written(spark, folder), N_REP, N_FOLD), N_FOLD)


@query("fold_table_single", f"WITH {KEPT}{REPS} SELECT rep, rep AS fold_index, 1 AS test_fold, case_id, 'train' AS role FROM kept, reps")
def _(spark, folder):
    return FO.fold_table(FO.shuffled_folds(written(spark, folder), N_REP, 1), 1)


@query(
    "fold_profile",
    f"WITH RECURSIVE {GROUPED} SELECT rep, fold, count(*) AS cases, CAST(sum(label) AS BIGINT) AS positives FROM grouped GROUP BY rep, fold",
)
def _(spark, folder):
    cases = written(spark, folder)
    return FO.fold_profile(cases, FO.grouped_folds(cases, N_REP, N_FOLD))


@query(
    "fold_checks",
    f"""WITH RECURSIVE {GROUPED}, per AS (SELECT rep, locus_id, count(*) AS n, min(fold) AS lo, max(fold) AS hi FROM grouped GROUP BY rep, locus_id)
    SELECT rep, CAST(sum(n) AS BIGINT) AS cases, CAST(0 AS BIGINT) AS unassigned, min(lo) AS min_fold, max(hi) AS max_fold,
    count(*) FILTER (lo <> hi) AS split_loci FROM per GROUP BY rep""",
)
def _(spark, folder):
    cases = written(spark, folder)
    return FO.fold_checks(cases, FO.grouped_folds(cases, N_REP, N_FOLD), N_REP)


@query("fold_caps_respected", f"""WITH RECURSIVE {GROUPED}, prof AS (SELECT rep, fold, count(*) AS n, sum(label) AS p FROM grouped GROUP BY rep, fold)
    SELECT rep, CAST(max(n) AS BIGINT) AS largest_cases, CAST(max(p) AS BIGINT) AS largest_positives,
    max(n) <= any_value(max_cases) AND max(p) <= any_value(max_positives) AS ok FROM prof, caps GROUP BY rep""")
def _(spark, folder):
    cases = written(spark, folder)
    caps = FO.fold_caps(cases, N_FOLD).select(F.struct("max_cases", "max_positives")).scalar()
    profile = FO.fold_profile(cases, FO.grouped_folds(cases, N_REP, N_FOLD))
    top = profile.groupBy("rep").agg(F.max("cases").alias("largest_cases"), F.max("positives").alias("largest_positives"))
    ok = (F.col("largest_cases") <= caps["max_cases"]) & (F.col("largest_positives") <= caps["max_positives"])
    return top.withColumn("ok", ok)
