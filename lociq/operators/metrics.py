"""Ranking metrics per task, exact under ties.

Every function takes ``keys``, the columns that identify one evaluation (for
example config_id, rep, fold, role), so all tasks are measured together. Equal
scores are counted together first, so the order of tied rows never matters, and
ordered sums run over cells of the score (see ``prefix``), so one very large
task or locus is not sorted in one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.scalars import reciprocal_span
from lociq.operators import joins
from lociq.operators.joins import join_large, join_sized
from lociq.operators.prefix import CELL, HEAVY_CELL, before_cell, heavy_cells, no_null, score_cells


def score_counts(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", heavy: Sequence[DataFrame] | None = None
) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per distinct score, with the score's cell; ``heavy`` from ``heavy_cells`` if known.

    A row with a NULL key belongs to no evaluation; a NULL score ranks last.
    """
    counts = df.where(no_null(keys)).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n")
    )
    return score_cells(counts, keys, heavy_cells(df, keys, score) if heavy is None else heavy)


def _quoted(keys: Sequence[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def _upto(keys: Sequence[str], sums: Sequence[str]) -> list[str]:
    """SQL of the running sums within a cell, best score first, this score included: ``t<c>``."""
    part = ", ".join([*_quoted(keys), CELL])
    return [f"sum({c}) OVER (PARTITION BY {part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS t{c}" for c in sums]


def threshold_counts(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", heavy: Sequence[DataFrame] | None = None
) -> DataFrame:
    """One row per threshold: p, n at the score, tp, fp at or above it, and totals pos, neg."""
    counts = score_counts(df, keys, score, label, heavy)
    cells = counts.groupBy(*keys, CELL).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    offsets = before_cell(cells, keys, ["p", "n"], descending=True)
    joined = join_large(counts.selectExpr("*", *_upto(keys, ["p", "n"])), offsets, [*keys, CELL])
    sums = ["tp + p_before AS tp", "tn + n_before AS fp", "p_total AS pos", "n_total AS neg"]
    return joined.selectExpr(*_quoted(keys), "score", "p", "n", *sums)


def _clipped(area: str, defined: str) -> str:
    return f"CASE WHEN {defined} THEN greatest(least({area}, 1D), 0D) END"


def _interpolated() -> str:
    """Part of the interpolated area under one tie group.

    Inside a group of p tied positives and n tied negatives the x-th positive
    stands at precision (tp0 + x) / (tp0 + fp0 + s x) with s = 1 + n/p. The
    trapezoids over x sum to a closed form, so a tie group costs the same
    whatever its size. Recall 0 takes the first group's limit.
    """
    s, above = "(1D + n / CAST(p AS DOUBLE))", "CAST(tp - p + fp - n AS DOUBLE)"
    z = f"({above} / {s})"
    inner = f"p / {s} + (tp - p - {z}) / {s} * {reciprocal_span(z, 'p')}"
    first = f"(CASE WHEN {above} > 0 THEN (tp - p) / {above} ELSE 1D / {s} END)"
    return f"CASE WHEN p > 0 THEN {inner} + ({first} - tp / CAST(tp + fp AS DOUBLE)) / 2D ELSE 0D END"


# SQL of every area over threshold rows; an area that is not defined (one class only) is NULL.
AREAS = {
    # A tie between classes counts half.
    "auroc": _clipped("sum(p * (neg - fp + n / 2D)) / max(pos) / max(neg)", "max(pos) * max(neg) > 0"),
    # Average precision: precision summed over steps of recall.
    "aupvr_step": _clipped("sum(CASE WHEN p > 0 THEN p * (tp / CAST(tp + fp AS DOUBLE)) ELSE 0D END) / max(pos)", "max(pos) > 0"),
    # Davis and Goadrich (2006).
    "aupvr_dg": _clipped(f"sum({_interpolated()}) / max(pos)", "max(pos) > 0"),
}
#: Folds up to which the counts of all (test fold, role) are columns of one row.
MOST_FOLDS = 16
# SQL of both average ranks over threshold rows within loci.
RANKS = {
    "avgrank_all": "try_divide(sum(p * (tp + fp - (p + n - 1) / 2D)), sum(p))",
    "avgrank_neg": "try_divide(sum(p * (1 + fp - n / 2D)), sum(p))",
}


def _area_columns(which: Sequence[str]) -> list[Column]:
    return [F.expr(AREAS[name]).alias(name) for name in which] + [F.max("pos").alias("positives"), F.max("neg").alias("negatives")]


def areas(
    df: DataFrame, keys: Sequence[str], which: Sequence[str] = tuple(AREAS), score: str = "score", label: str = "label"
) -> DataFrame:
    """The chosen areas per evaluation from one pass over the thresholds."""
    return threshold_counts(df, keys, score, label).groupBy(*keys).agg(*_area_columns(which))


def auroc(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; a tie between classes counts half."""
    return areas(df, keys, ["auroc"], score, label).select(*keys, "auroc")


def aupvr_step(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: precision summed over steps of recall."""
    return areas(df, keys, ["aupvr_step"], score, label).select(*keys, "aupvr_step")


def aupvr_dg(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """Interpolated area under the precision-recall curve (Davis and Goadrich 2006)."""
    return areas(df, keys, ["aupvr_dg"], score, label).select(*keys, "aupvr_dg")


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score."""
    points = threshold_counts(df, keys, score, label)
    return points.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "neg").alias("fpr"),
        F.try_divide("tp", "pos").alias("tpr"),
    )


def pr_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, recall, precision) per distinct score."""
    points = threshold_counts(df, keys, score, label)
    return points.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide("tp", "pos").alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def locus_rank_sums(df: DataFrame, keys: Sequence[str], locus: str = "locus_id", score: str = "score", label: str = "label") -> DataFrame:
    """Per locus: positives and the sums of their ranks against all members and against negatives only.

    Ranks add up: what stands above within the cell, plus what the better cells
    hold, so no row has to be joined to an offset.
    """
    where = [*keys, locus]
    counts = score_counts(df, where, score, label)
    cells = counts.selectExpr("*", *_upto(where, ["p", "n"])).groupBy(*where, CELL).agg(
        F.sum("p").alias("p"),
        F.sum("n").alias("n"),
        F.expr("sum(p * (tp - p + tn - n + (p + n + 1) / 2D))").alias("inner_all"),
        F.expr("sum(p * (1 + tn - n / 2D))").alias("inner_neg"),
    )
    part = ", ".join(_quoted(where))
    better = f"OVER (PARTITION BY {part} ORDER BY {CELL} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = cells.selectExpr("*", f"coalesce(sum(p + n) {better}, 0) AS above_all", f"coalesce(sum(n) {better}, 0) AS above_neg")
    return ranked.groupBy(*where).agg(
        F.expr("sum(p + n)").alias("cases"),
        F.sum("p").alias("positives"),
        F.expr("sum(inner_all + p * above_all)").alias("rank_sum_all"),
        F.expr("sum(inner_neg + p * above_neg)").alias("rank_sum_neg"),
    )


def avgranks(df: DataFrame, keys: Sequence[str], locus: str = "locus_id", score: str = "score", label: str = "label") -> DataFrame:
    """Mean within-locus rank of the positives, best score first, ties averaged.

    ``avgrank_all`` ranks a positive among all members of its locus,
    ``avgrank_neg`` only among the negatives.
    """
    sums = locus_rank_sums(df, keys, locus, score, label)
    return sums.groupBy(*keys).agg(
        F.try_divide(F.sum("rank_sum_all"), F.sum("positives")).alias("avgrank_all"),
        F.try_divide(F.sum("rank_sum_neg"), F.sum("positives")).alias("avgrank_neg"),
    )


def within_locus_rank(df: DataFrame, keys: Sequence[str], locus: str = "locus_id", score: str = "score", label: str = "label") -> DataFrame:
    """Add ``locus_rank``: rank of every case in its locus, best score first, ties averaged."""
    where = [*keys, locus]
    heavy = heavy_cells(df, where, score)
    points = threshold_counts(df, where, score, label, heavy)
    size = F.col("p") + F.col("n")
    ranks = points.select(*where, F.col("score").alias(score), (F.col("tp") + F.col("fp") - (size - 1) / 2.0).alias("locus_rank"), size.alias("_size"))
    # A tie group lies in one cell, so where no cell is heavy no group is.
    return join_sized(df, ranks, [*where, score], "_size", most=None if heavy else HEAVY_CELL, large=True)


def locus_gaps(evaluated: DataFrame, overall: DataFrame, keys: Sequence[str], locus: str = "locus_id") -> DataFrame:
    """Loci of the evaluated sets that miss some of their members; empty when ranks are valid."""
    inside = evaluated.groupBy(*keys, locus).agg(F.count(F.lit(1)).alias("evaluated"))
    whole = overall.groupBy(locus).agg(F.count(F.lit(1)).alias("members"))
    return inside.join(whole, locus).where(F.col("evaluated") < F.col("members"))


def require_whole_loci(df: DataFrame, keys: Sequence[str], locus: str = "locus_id", fold: str = "fold") -> None:
    """An error when a locus is spread over several folds: ranks inside it would miss members."""
    torn = df.groupBy(*keys, locus).agg(F.min(fold).alias("low"), F.max(fold).alias("high")).where("low < high").first()
    if torn is not None:
        raise ValueError(f"ranks need whole loci, but {torn[locus]} is in folds {torn['low']} to {torn['high']}")


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    grouped: bool = True,
    which: Sequence[str] = tuple(AREAS),
    locus: str = "locus_id",
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """All areas, and with ``grouped`` the within-locus ranks, per evaluation."""
    out = areas(df, keys, which, score, label)
    if not grouped:
        return out
    return out.join(avgranks(df, keys, locus, score, label), list(keys))


def fold_points(df: DataFrame, keys: Sequence[str], n_fold: int, score: str = "score", label: str = "label", fold: str = "fold") -> DataFrame:
    """Threshold rows of the test and train side of every fold, for scores that do not depend on the fold.

    The counts of all folds travel as columns of one row per distinct score, so
    ordering and shuffling happen once, not once per fold and role; only the
    last step, which feeds an aggregate, spreads a row over (test_fold, role).
    The train side is the whole minus the test side.
    """
    folds = range(1, n_fold + 1)
    columns = [f"{c}{k}" for c in "pn" for k in folds]
    hits = {"p": f"`{label}`", "n": f"1 - `{label}`"}
    tallies = [F.expr(f"sum(CASE WHEN `{fold}` = {k} THEN CAST({hits[c]} AS BIGINT) ELSE 0L END)").alias(f"{c}{k}") for c in "pn" for k in folds]
    counts = df.where(no_null(keys)).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(*tallies)
    counts = score_cells(counts, keys, heavy_cells(df, keys, score))
    cells = counts.groupBy(*keys, CELL).agg(*[F.sum(c).alias(c) for c in columns])
    offsets = before_cell(cells, keys, columns, descending=True)
    joined = join_large(counts.selectExpr("*", *_upto(keys, columns)), offsets, [*keys, CELL])

    # Name of a count and its SQL for fold k.
    parts = {
        "p": "p{k}",
        "n": "n{k}",
        "tp": "tp{k} + p{k}_before",
        "fp": "tn{k} + n{k}_before",
        "pos": "p{k}_total",
        "neg": "n{k}_total",
    }
    whole = [" + ".join(sql.format(k=k) for k in folds) + f" AS all_{name}" for name, sql in parts.items()]
    mine = ", ".join(f"named_struct('test_fold', {k}, " + ", ".join(f"'{name}', {sql.format(k=k)}" for name, sql in parts.items()) + ")" for k in folds)
    # With a single fold there is nothing to test on: every case trains.
    roles = "'test', 'train'" if n_fold > 1 else "'train'"
    side = "CASE WHEN role = 'test' THEN {c} ELSE all_{c} - {c} END AS {c}" if n_fold > 1 else "{c}"
    out = _quoted(keys)
    return (
        joined.selectExpr(*out, "score", *whole, f"explode(array({mine})) AS _m")
        .selectExpr(*out, "score", "_m.*", *[f"all_{name}" for name in parts], f"explode(array({roles})) AS role")
        .selectExpr(*out, "test_fold", "role", "score", *[side.format(c=name) for name in parts])
        .where("p + n > 0")
    )


def evaluate_folds(
    df: DataFrame,
    keys: Sequence[str],
    n_fold: int,
    grouped: bool = True,
    which: Sequence[str] = tuple(AREAS),
    locus: str = "locus_id",
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Like ``evaluate`` for every (keys, test_fold, role), for scores that do not depend on the fold."""
    task = [*keys, "test_fold", "role"]
    out = fold_points(df, keys, n_fold, score, label).groupBy(*task).agg(*_area_columns(which))
    if not grouped:
        return out
    within = fold_points(df, [*keys, locus], n_fold, score, label)
    ranks = within.groupBy(*task).agg(*[F.expr(sql).alias(name) for name, sql in RANKS.items()])
    return out.join(ranks, task)


def side_points(
    members: DataFrame, keys: Sequence[str], n_fold: int, score: str = "score", label: str = "label", whole: bool = False
) -> DataFrame:
    """Threshold rows of every (test_fold, role) of ``members``, which have these two columns.

    Members are counted where they say they belong, so scores may depend on the fold and nothing is
    taken as the rest of something else. The counts of all sides travel as columns of one row per distinct score: the rows of a case, one
    for each test fold, are one before the first shuffle. With ``whole`` a group of ``keys`` is sorted in one piece, not by cells.
    A side that is none of ``n_fold`` is an error.
    """
    sides = [(k, role) for role in ("test", "train") for k in range(1, n_fold + 1)]
    at = " ".join(f"WHEN role = '{role}' AND test_fold = {k} THEN {i}" for i, (k, role) in enumerate(sides))
    unknown = f"raise_error(concat('no side of {n_fold} folds: ', test_fold, ' ', role))"
    rows = members.where(no_null([*keys, "test_fold", "role"])).selectExpr(
        *_quoted(keys), f"CAST(`{score}` AS DOUBLE) AS score", f"CAST(`{label}` AS BIGINT) AS _label", f"CASE {at} ELSE CAST({unknown} AS INT) END AS _side"
    )
    columns = [f"{c}{i}" for c in "pn" for i in range(len(sides))]
    hits = {"p": "coalesce(_label, 0L)", "n": "coalesce(1L - _label, 0L)"}
    tallies = [F.expr(f"sum(CASE WHEN _side = {i} THEN {hits[c]} ELSE 0L END)").alias(f"{c}{i}") for c in "pn" for i in range(len(sides))]
    # Bits of the sides that have members at the score, with or without a label; both branches below read them, and so the same exchange.
    counts = rows.groupBy(*keys, "score").agg(*tallies, F.expr("bit_or(shiftleft(1L, _side))").alias("_seen")).where("_seen <> 0")
    parts = {"p": "p{i}", "n": "n{i}"}
    if whole:
        part = ", ".join(_quoted(keys))
        points = counts.selectExpr("*", *[f"sum({c}) OVER (PARTITION BY {part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS t{c}" for c in columns])
        parts |= {"tp": "tp{i}", "fp": "tn{i}"}
    else:
        counts = score_cells(counts, keys, heavy_cells(members, keys, score))
        cells = counts.groupBy(*keys, CELL).agg(*[F.sum(c).alias(c) for c in columns])
        points = join_large(counts.selectExpr("*", *_upto(keys, columns)), before_cell(cells, keys, columns, descending=True), [*keys, CELL])
        parts |= {"tp": "tp{i} + p{i}_before", "fp": "tn{i} + n{i}_before", "pos": "p{i}_total", "neg": "n{i}_total"}
    mine = ", ".join(
        f"named_struct('test_fold', {k}, 'role', '{role}', 'members', shiftright(_seen, {i}) & 1L, " + ", ".join(f"'{name}', {sql.format(i=i)}" for name, sql in parts.items()) + ")"
        for i, (k, role) in enumerate(sides)
    )
    out = [*_quoted(keys), "score"]
    return points.selectExpr(*out, f"explode(array({mine})) AS _m").selectExpr(*out, "_m.*").where("members = 1").drop("members")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group of ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def evaluate_sides(
    members: DataFrame,
    keys: Sequence[str],
    n_fold: int,
    grouped: bool = True,
    which: Sequence[str] = tuple(AREAS),
    locus: str = "locus_id",
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Equal to ``evaluate`` by (keys, test_fold, role) for members of up to ``MOST_FOLDS`` folds."""
    task = [*keys, "test_fold", "role"]
    out = side_points(members, keys, n_fold, score, label).groupBy(*task).agg(*_area_columns(which))
    if not grouped:
        return out
    # Loci are sorted in one piece unless one is heavy, with all tasks together or in one of them.
    whole = any(largest_group(members.where(F.col(locus).isNotNull()), by) <= joins.HEAVY_ROWS for by in ([locus], [*keys, locus]))
    within = side_points(members, [*keys, locus], n_fold, score, label, whole)
    ranks = within.groupBy(*task).agg(*[F.expr(sql).alias(name) for name, sql in RANKS.items()])
    return out.join(ranks, task)
