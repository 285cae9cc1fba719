"""Assignment of cases to cross-validation folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.draws import uniform, uniform_py
from lociq.operators import joins
from lociq.operators.joins import join_large, join_sized
from lociq.operators.loci import keep_positive_loci, locus_summary
from lociq.operators.prefix import numbered
from lociq.session import cut_lineage

# Defaults of the fold assignment.
DEFAULT_SLACK = 0.5
DEFAULT_SEED = 1337


def fold_caps(df: DataFrame, n_fold: int, slack: float = DEFAULT_SLACK, label: str = "label") -> DataFrame:
    """One row: cases, positives and the largest number of each that a fold may hold."""
    counts = df.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    max_cases = F.ceil(F.lit(1.0 + slack) * F.col("cases") / n_fold)
    max_positives = F.ceil(F.lit(1.0 + slack) * F.col("max_cases") * F.col("positives") / F.col("cases"))
    return counts.withColumn("max_cases", max_cases).withColumn("max_positives", max_positives)


def fold_count_feasible(df: DataFrame, n_fold: int, label: str = "label") -> DataFrame:
    """One row: may the table be cut into ``n_fold`` folds (fewer folds than positives)?"""
    positives = F.sum(F.col(label).cast("bigint"))
    negatives = F.count(F.lit(1)) - positives
    limit = F.count(F.lit(1)) / (negatives / positives + 1)
    return df.agg(positives.alias("positives"), negatives.alias("negatives"), (F.lit(n_fold) < limit).alias("feasible"))


def with_replications(df: DataFrame, n_rep: int) -> DataFrame:
    """Every row once per replication 1..n_rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_rep))))


def shuffled_folds(
    df: DataFrame, n_rep: int, n_fold: int, seed: int = DEFAULT_SEED, case: str = "case_id", by: str | None = None, cells: int = 4096
) -> DataFrame:
    """Plain random folds: (case, rep, fold), sizes within a replication differ by at most one.

    ``by`` deals the cases of each value (such as the label) apart.
    """
    kept = [case] if by is None else [case, by]
    keys = ["rep"] if by is None else ["rep", by]
    rows = with_replications(df.select(*kept), n_rep)
    dealt = numbered(rows, keys, uniform(seed, "rep", case), case, cells=cells)
    return dealt.select(case, "rep", ((F.col("position") - 1) % n_fold + 1).cast("int").alias("fold"))


def stratified_folds(
    df: DataFrame, n_rep: int, n_fold: int, seed: int = DEFAULT_SEED, case: str = "case_id", label: str = "label", cells: int = 4096
) -> DataFrame:
    """Random folds dealt within each label value."""
    return shuffled_folds(df, n_rep, n_fold, seed, case, by=label, cells=cells)


def grouped_folds(
    df: DataFrame,
    n_rep: int,
    n_fold: int,
    slack: float = DEFAULT_SLACK,
    seed: int = DEFAULT_SEED,
    case: str = "case_id",
    locus: str = "locus_id",
    label: str = "label",
    loci_per_draw: int = 1,
    cells: int = 4096,
    on_missing: str = "ignore",
) -> DataFrame:
    """Whole loci to folds under caps on cases and positives: (case, rep, fold)."""
    df = keep_positive_loci(df, locus, label, on_missing)
    # Small next to the cases and read by three branches, so written once.
    loci = cut_lineage(locus_summary(df, locus, label))
    folds = locus_folds(loci, n_rep, n_fold, slack, seed, locus, loci_per_draw, cells)
    # One row per locus with all its replications, so cases are shuffled once, not once per replication.
    per_locus = folds.groupBy(locus).agg(F.array_sort(F.collect_list(F.struct("rep", "fold"))).alias("_folds"))
    largest = loci.agg(F.max("cases")).first()[0] or 0
    if largest > joins.HEAVY_ROWS:
        per_locus = join_large(per_locus, loci.select(locus, F.col("cases").alias("_size")), [locus])
    return (
        join_sized(df.select(case, locus), per_locus, [locus], "_size", most=largest, large=True)
        .select(case, F.explode("_folds").alias("_f"))
        .select(case, F.col("_f.rep").alias("rep"), F.col("_f.fold").alias("fold"))
    )


def locus_folds(
    loci: DataFrame,
    n_rep: int,
    n_fold: int,
    slack: float = DEFAULT_SLACK,
    seed: int = DEFAULT_SEED,
    locus: str = "locus_id",
    loci_per_draw: int = 1,
    cells: int = 4096,
) -> DataFrame:
    """(locus, rep, fold) from a locus summary (locus, cases, positives).

    Loci go largest first to one of the folds that still have room, with
    probability proportional to the room left for cases times the room left for
    positives. Loci of the same shape (cases, positives) are interchangeable:
    only the table of shapes is walked in order, once per replication, and
    every locus then finds its draw by its random position within its shape.

    Every locus is drawn by itself whatever the number of loci, with time and
    memory in proportion to the loci of a replication. ``loci_per_draw`` above 1
    deals that many loci of a shape with each draw, in the proportions of the
    weights; it is the caller's choice and never follows from the size.
    """
    shapes = loci.groupBy("cases", "positives").agg(F.count(F.lit(1)).alias("loci"))
    plan = with_replications(shapes, n_rep).groupBy("rep").applyInPandas(
        _dealer(n_fold, slack, seed, loci_per_draw),
        "rep int, cases bigint, positives bigint, step bigint, upto array<bigint>",
    )
    placed = numbered(
        with_replications(loci, n_rep), ["rep", "cases", "positives"], uniform(seed, "rep", locus), locus, cells=cells
    )
    at = F.col("position") - 1
    placed = placed.withColumn("step", F.floor(at / loci_per_draw)).withColumn("_at", at - F.col("step") * loci_per_draw)
    # The plan has a row for every locus and replication, though it is made of few shapes.
    dealt = join_large(placed, plan, ["rep", "cases", "positives", "step"])
    fold = F.size(F.filter("upto", lambda n: n <= F.col("_at"))) + 1
    return dealt.select(locus, "rep", fold.cast("int").alias("fold"))


def _dealer(n_fold: int, slack: float, seed: int, loci_per_draw: int) -> Callable:
    """Walk the shapes of one replication; the state is two counters per fold."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = int(pdf["rep"].iloc[0])
        shapes = pdf.sort_values(["cases", "positives"], ascending=False)
        n_cases = int((shapes["cases"] * shapes["loci"]).sum())
        n_pos = int((shapes["positives"] * shapes["loci"]).sum())
        max_cases = math.ceil((1.0 + slack) * n_cases / n_fold)
        max_pos = math.ceil((1.0 + slack) * max_cases * n_pos / n_cases)
        if loci_per_draw == 1:
            walked = _walk(shapes[["cases", "positives", "loci"]].itertuples(index=False), n_fold, max_cases, max_pos, lambda i: uniform_py(seed, rep, "draw", i))
            # Loci on one fold share one list, so a locus costs a few bytes.
            upto = [[int(k >= fold) for k in range(n_fold)] for fold in range(n_fold)]
            plan = shapes.loc[shapes.index.repeat(shapes["loci"]), ["cases", "positives"]].reset_index(drop=True)
            steps = np.concatenate([np.arange(n, dtype=np.int64) for n in shapes["loci"]])
            return plan.assign(rep=rep, step=steps, upto=[upto[fold] for fold in walked])[["rep", "cases", "positives", "step", "upto"]]
        used = np.zeros((2, n_fold), dtype=np.int64)
        rows, drawn = [], 0
        for size, positives, loci in shapes[["cases", "positives", "loci"]].itertuples(index=False):
            unit = np.array([[size], [positives]])
            left, step = int(loci), 0
            while left:
                batch = min(loci_per_draw, left)
                got = np.zeros(n_fold, dtype=np.int64)
                while got.sum() < batch:
                    room = (max_cases - used[0]) // size
                    if positives:
                        room = np.minimum(room, (max_pos - used[1]) // positives)
                    if not (room > 0).any():
                        raise ValueError(f"no fold has room for a locus of {size} cases, {positives} positives")
                    weights = (1 - used[0] / max_cases) * (1 - used[1] / max(max_pos, 1))
                    weights = np.where(room > 0, weights, 0.0)
                    if not weights.any():
                        weights = (room > 0).astype(float)
                    drawn += 1
                    need, u = int(batch - got.sum()), uniform_py(seed, rep, "draw", drawn)
                    add = _one_of(weights, u) if need == 1 else np.minimum(_shares(weights, need, u), room)
                    got += add
                    used += unit * add
                rows.append((rep, size, positives, step, got.cumsum()))
                left, step = left - batch, step + 1
        return pd.DataFrame(rows, columns=["rep", "cases", "positives", "step", "upto"])

    return deal


def _walk(shapes: Iterable[tuple[int, int, int]], n_fold: int, max_cases: int, max_pos: int, draw: Callable[[int], float]) -> bytearray | list[int]:
    """The fold (from 0) of every locus of the (cases, positives, loci) in their order, each drawn by itself."""
    cases, pos = [0] * n_fold, [0] * n_fold
    share, folds = [1.0] * n_fold, range(n_fold)
    out, drawn = bytearray() if n_fold <= 256 else [], 0
    for size, positives, loci in shapes:
        for _ in range(loci):
            free = [f for f in folds if cases[f] + size <= max_cases and (not positives or pos[f] + positives <= max_pos)]
            if not free:
                raise ValueError(f"no fold has room for a locus of {size} cases, {positives} positives")
            drawn += 1
            total, edges = 0.0, []
            if not any(share[f] for f in free):
                for f in free:
                    total += 1.0
                    edges.append((total, f))
            else:
                for f in free:
                    if share[f]:
                        total += share[f]
                        edges.append((total, f))
            point = draw(drawn) * total
            pick = next((f for edge, f in edges if edge > point), edges[-1][1])
            cases[pick] += size
            pos[pick] += positives
            share[pick] = (1 - cases[pick] / max_cases) * (1 - pos[pick] / max(max_pos, 1))
            out.append(pick)
    return out


def _one_of(weights: np.ndarray, u: float) -> np.ndarray:
    """One unit on a fold chosen with the given weights."""
    edges = weights.cumsum()
    pick = min((edges <= u * edges[-1]).sum(), np.flatnonzero(weights)[-1])
    return np.eye(len(weights), dtype=np.int64)[pick]


def _shares(weights: np.ndarray, need: int, u: float) -> np.ndarray:
    """``need`` units dealt in the proportions of the weights: evenly spaced points with one random start."""
    upto = np.clip(np.ceil(weights.cumsum() / weights.sum() * need - u), 0, need).astype(np.int64)
    upto[np.flatnonzero(weights)[-1] :] = need
    return np.diff(upto, prepend=0)


def assign_folds(df: DataFrame, method: str, n_rep: int, n_fold: int, **options) -> DataFrame:
    """Fold assignment by method name: ``SNP`` (case by case), ``STRATIFIED`` or ``LOCUS``."""
    methods = {"SNP": shuffled_folds, "STRATIFIED": stratified_folds, "LOCUS": grouped_folds}
    if method not in methods:
        raise ValueError(f"fold method must be one of {sorted(methods)}, not {method}")
    return methods[method](df, n_rep, n_fold, **options)


def fold_table(folds: DataFrame, n_fold: int, case: str = "case_id") -> DataFrame:
    """Role of every case in every (rep, test fold): (rep, fold_index, test_fold, case, role).

    With a single fold there is nothing to test on and every case trains.
    """
    role = F.when((F.lit(n_fold) > 1) & (F.col("fold") == F.col("test_fold")), "test").otherwise("train")
    return (
        folds.withColumn("test_fold", F.explode(F.sequence(F.lit(1), F.lit(n_fold))))
        .withColumn("fold_index", (F.col("rep") - 1) * n_fold + F.col("test_fold"))
        .select("rep", "fold_index", "test_fold", case, role.alias("role"))
    )


def fold_profile(cases: DataFrame, folds: DataFrame, case: str = "case_id", label: str = "label") -> DataFrame:
    """Cases and positives per (rep, fold)."""
    return (
        join_large(folds, cases.select(case, label), [case])
        .groupBy("rep", "fold")
        .agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    )


def fold_checks(cases: DataFrame, folds: DataFrame, n_rep: int, case: str = "case_id", locus: str = "locus_id") -> DataFrame:
    """Per replication: cases without a fold, fold range, and loci spread over several folds."""
    joined = join_large(with_replications(cases.select(case, locus), n_rep), folds, [case, "rep"], "left")
    per_locus = joined.groupBy("rep", locus).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("fold").isNull(), 1).otherwise(0)).alias("gaps"),
        F.min("fold").alias("low"),
        F.max("fold").alias("high"),
    )
    return per_locus.groupBy("rep").agg(
        F.sum("n").alias("cases"),
        F.sum("gaps").cast("bigint").alias("unassigned"),
        F.min("low").alias("min_fold"),
        F.max("high").alias("max_fold"),
        F.sum(F.when(F.col("low") != F.col("high"), 1).otherwise(0)).cast("bigint").alias("split_loci"),
    )
