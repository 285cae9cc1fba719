"""Summaries and comparisons of performance results.

Results are kept long: (config_id, rep, fold, metric, value). Everything that
gathers values into a list gathers the values of one configuration and metric,
which are as many as replications x folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.draws import hash_bits
from lociq.functions.scalars import inv_logit, logit, logit_mean
from lociq.functions.student import two_sided_p

# Metrics averaged on the logit scale, and the number of resamples.
LOGIT_METRICS = r"auroc|aupvr"
RESAMPLES = 1000
# Resamples made from one copy of the values.
BLOCK = 50


def to_long(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to rows (keys, metric, value)."""
    return results.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def wide_results(long: DataFrame, n_rep: int, n_fold: int, metrics: Sequence[str], config: str = "config_id") -> DataFrame:
    """One row per configuration, one column ``<metric>_<rep>_<fold>`` per value."""
    names = [f"{m}_{r}_{f}" for m in metrics for r in range(1, n_rep + 1) for f in range(1, n_fold + 1)]
    slot = F.concat_ws("_", "metric", "rep", "fold")
    return long.withColumn("_slot", slot).groupBy(config).pivot("_slot", names).agg(F.first("value"))


def _mean_of(values: Column, eps: float | None = None) -> Column:
    return F.when(F.col("metric").rlike(LOGIT_METRICS), logit_mean(F.when(F.col("metric").rlike(LOGIT_METRICS), values), eps)).otherwise(F.avg(values))


def average_results(long: DataFrame, keys: Sequence[str] = ("config_id", "metric"), eps: float | None = None) -> DataFrame:
    """Mean per configuration and metric: logit mean for areas, plain mean for ranks.

    Missing values (a fold with one class) stay out of the mean and are counted.
    """
    return long.groupBy(*keys).agg(
        _mean_of(F.col("value"), eps).alias("average"),
        F.count("value").cast("bigint").alias("n_values"),
        F.sum(F.col("value").isNull().cast("int")).cast("bigint").alias("n_missing"),
    )


def averages_wide(averages: DataFrame, metrics: Sequence[str], prefix: str = "avg_", value: str = "average", config: str = "config_id") -> DataFrame:
    """One row per configuration with one column per metric."""
    picked = [F.max(F.when(F.col("metric") == m, F.col(value))).alias(f"{prefix}{m}") for m in metrics]
    return averages.groupBy(config).agg(*picked)


def bootstrap_means(
    long: DataFrame, n_resamples: int = RESAMPLES, seed: int = 1337, keys: Sequence[str] = ("config_id",), eps: float | None = None
) -> DataFrame:
    """Mean of every resample: (keys, metric, resample, average).

    Values are ordered by (rep, fold) and resample b draws position j by a hash
    of (seed, keys, b, j), so all metrics of a configuration share their draws. A block of resamples shares one copy of
    the values: positions are drawn once for all metrics, and what is shuffled does not grow with the resamples of a block.
    """
    order = [c for c in ("hp_no", "rep", "fold") if c in long.columns and c not in keys]
    usable = F.when(F.col("metric").rlike(LOGIT_METRICS), logit(F.when(F.col("metric").rlike(LOGIT_METRICS), F.col("value")), eps)).otherwise(F.col("value"))
    lists = (
        long.where(F.col("value").isNotNull())
        .groupBy(*keys, "metric")
        .agg(F.array_sort(F.collect_list(F.struct(*order, usable.alias("v")))).alias("_s"))
        .select(*keys, "metric", F.col("_s.v").alias("_s"), F.size("_s").alias("_n"))
    )
    # Metrics with as many values have the same draws, so they go side by side.
    side_by_side = lists.groupBy(*keys, "_n").agg(F.collect_list(F.struct("metric", "_s")).alias("_m"))
    blocks = F.sequence(F.lit(0), F.lit(n_resamples - 1), F.lit(BLOCK))
    dealt = side_by_side.withColumn("_first", F.explode(blocks)).repartition(*keys, "_n", "_first")
    each = dealt.withColumn("resample", F.explode(F.sequence("_first", F.least(F.col("_first") + BLOCK - 1, F.lit(n_resamples - 1)))))
    drawn = each.withColumn("_at", F.transform(F.sequence(F.lit(1), F.col("_n")), lambda j: (F.pmod(hash_bits(seed, *keys, "resample", j), F.col("_n")) + 1).cast("int")))
    means = drawn.select(*keys, "resample", "_n", "_at", F.explode("_m").alias("_z")).select(
        *keys, F.col("_z")["metric"].alias("metric"), "resample", (F.aggregate("_at", F.lit(0.0), lambda acc, k: acc + F.element_at(F.col("_z")["_s"], k)) / F.col("_n")).alias("_mean")
    )
    return means.select(*keys, "metric", "resample", F.when(F.col("metric").rlike(LOGIT_METRICS), inv_logit("_mean")).otherwise(F.col("_mean")).alias("average"))


def bootstrap_intervals(means: DataFrame, keys: Sequence[str] = ("config_id",), level: float = 0.95) -> DataFrame:
    """Quantile interval of the resample means (linear interpolation between order statistics)."""
    tail = (1.0 - level) / 2.0
    ends = F.percentile("average", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return means.groupBy(*keys, "metric").agg(ends.alias("_e")).select(
        *keys, "metric", F.col("_e")[0].alias("lower95"), F.col("_e")[1].alias("upper95")
    )


def best_configurations(
    long: DataFrame, metric: str, largest: bool, by: Sequence[str] = ("method",), config: str = "hp_no"
) -> DataFrame:
    """Per method the configuration with the best plain mean; the first one wins a tie."""
    means = long.where(F.col("metric") == metric).groupBy(*by, config).agg(F.avg("value").alias("mean_value"))
    rank = Window.partitionBy(*by).orderBy((F.col("mean_value").desc() if largest else F.col("mean_value").asc_nulls_last()), config)
    return means.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def rows_of_best(results: DataFrame, best: DataFrame, by: Sequence[str] = ("method",), config: str = "hp_no") -> DataFrame:
    """All result rows of the best configurations."""
    return results.join(best.select(*by, config), [*by, config], "left_semi")


def paired_t(long: DataFrame, reference: DataFrame, metric: str = "test_aupvr", eps: float | None = None, config: str = "config_id") -> DataFrame:
    """Paired t-test on the logit scale of every configuration against the reference one.

    ``reference`` has one row with ``config_id``. Pairs are matched by (rep, fold).
    t is NULL with fewer than two values, with a missing value, with a fold that only one of the two has, or without spread.
    """
    values = long.where(F.col("metric") == metric).select(config, "rep", "fold", logit("value", eps).alias("x"))
    base = values.join(reference.select(config), config, "left_semi").select("rep", "fold", F.col("x").alias("x0"))
    others = values.join(reference.select(config), config, "left_anti")
    # Folds of either side without a partner stay, with a missing difference.
    folds = base.select("rep", "fold", F.col("x0"), F.lit(True).alias("_in"))
    wanted = others.select(config).distinct().crossJoin(F.broadcast(folds))
    diffs = others.join(wanted, [config, "rep", "fold"], "full_outer").withColumn("d", F.col("x0") - F.col("x"))
    n = F.count(F.lit(1))
    complete = (n > 1) & (F.count("d") == n) & (F.stddev_samp("d") > 0)
    return diffs.groupBy(config).agg(
        F.avg("d").alias("mean_difference"),
        F.when(complete, F.avg("d") / (F.stddev_samp("d") / F.sqrt(n.cast("double")))).alias("t"),
        (n - 1).alias("df"),
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    """Two-sided p-value of (t, df)."""
    return tests.withColumn("pvalue", two_sided_p("t", "df"))


def final_table(
    configs: DataFrame,
    averages: DataFrame,
    intervals: DataFrame,
    tests: DataFrame,
    metrics: Sequence[str],
    sort_by: str = "avg_test_aupvr",
    wide: DataFrame | None = None,
    config: str = "config_id",
) -> DataFrame:
    """Identifiers, averages, interval ends, p-value and (optionally) the wide values, best first."""
    out = (
        configs.join(averages_wide(averages, metrics, config=config), config)
        .join(averages_wide(intervals, metrics, "lower_95ci_", "lower95", config), config)
        .join(averages_wide(intervals, metrics, "upper_95ci_", "upper95", config), config)
        .join(tests.select(config, "pvalue"), config, "left")
    )
    if wide is not None:
        out = out.join(wide, config)
    return out.select(config, *[c for c in out.columns if c != config]).orderBy(F.col(sort_by).desc_nulls_last(), config)


def plot_rows(final: DataFrame, metrics: Sequence[str], config: str = "config_id") -> DataFrame:
    """Long form for plotting: (config, set_name, hp_text, metric, value, lower95, upper95)."""
    packs = [
        F.struct(
            F.lit(m.removeprefix("test_").upper()).alias("metric"),
            F.col(f"avg_{m}").alias("value"),
            F.col(f"lower_95ci_{m}").alias("lower95"),
            F.col(f"upper_95ci_{m}").alias("upper95"),
        )
        for m in metrics
    ]
    return final.select(config, "set_name", "hp_text", F.explode(F.array(*packs)).alias("_p")).select(config, "set_name", "hp_text", "_p.*")


def plot_selection(rows: DataFrame, only_sets: Sequence[str], text: str = "scale_pos_weight=1") -> DataFrame:
    """Rows of the named sets only where the parameters contain ``text``; all rows of other sets."""
    named = F.col("set_name").isin(list(only_sets))
    return rows.where((named & F.col("hp_text").contains(text)) | ~named)


def plot_labels(rows: DataFrame, strip: str = "_published") -> DataFrame:
    """Clean set names and number them per metric by value, ascending but descending for AVGRANK."""
    falling = F.col("metric").startswith("AVGRANK")
    order = Window.partitionBy("metric").orderBy(F.when(falling, -F.col("value")).otherwise(F.col("value")), "config_id")
    return rows.withColumn("set_name", F.regexp_replace("set_name", strip, "")).withColumn("place", F.row_number().over(order))


def box_statistics(df: DataFrame, keys: Sequence[str], value: str = "average", whisker: float = 2.5) -> DataFrame:
    """Quartiles, whisker ends (extreme values within ``whisker`` x IQR of the box) and outlier count."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = df.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")
    )
    joined = df.join(boxes, list(keys))
    reach = (F.col("q3") - F.col("q1")) * whisker
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum((~inside).cast("int")).cast("bigint").alias("outliers"),
    )


def scatter(final: DataFrame, max_avgrank: float | None = None, min_aupvr: float | None = None, rank: str = "avg_test_avgrank", area: str = "avg_test_aupvr") -> DataFrame:
    """AVGRANK against AUPVR, optionally the zoomed part (fixed values of the zoom: 4.75 and 0.4)."""
    out = final.select("config_id", rank, area)
    if max_avgrank is not None:
        out = out.where(F.col(rank) <= max_avgrank)
    if min_aupvr is not None:
        out = out.where(F.col(area) >= min_aupvr)
    return out


def distinct_configurations(results: DataFrame, config: str = "config_id") -> DataFrame:
    return results.select(config).distinct()
