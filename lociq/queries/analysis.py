"""Summaries and comparisons of the given-score results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions.scalars import hp_text, logit_mean
from lociq.operators import analysis as A
from lociq.plans.validation import results_long
from lociq.queries import query, rounded
from lociq.queries.metrics import results
from lociq.queries.sql import IS_AREA, LONG, N_FOLD, N_REP, RESULT_METRICS, inv_logit, logit, r6
from lociq.session import cut_lineage
from lociq.sources.fixtures import cases, given_scores

# The names used by the summary table: the interpolated area and the rank against negatives.
RENAMED = {f"{r}_{old}": f"{r}_{new}" for r in ("test", "train") for old, new in (("aupvr_dg", "aupvr"), ("auroc", "auroc"), ("avgrank_neg", "avgrank"))}
NAMES = list(RENAMED.values())
_rename = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items())
PERF = f"""{LONG},
perf AS (SELECT config_id, rep, fold, CASE metric {_rename} END AS metric, value FROM long WHERE metric IN ({", ".join(f"'{m}'" for m in RENAMED)}))"""
# Two methods: the value and its negative are two settings of one, the hash is the other.
METHOD = "CASE WHEN config_id <= 2 THEN 'raw' ELSE 'hash' END"
ON_SCALE = f"CASE WHEN {IS_AREA} THEN {logit('value')} ELSE value END"
AVERAGES = f"""{PERF},
averages AS (
  SELECT config_id, metric, CASE WHEN {IS_AREA} THEN {inv_logit(f"avg({ON_SCALE})")} ELSE avg(value) END AS average,
         count(value) AS n_values, count(*) - count(value) AS n_missing
  FROM perf GROUP BY config_id, metric)"""


def means_sql(keys: str, rel: str, n: int, order: str, name: str = "means") -> str:
    text = " || '|' || ".join(["'1337'", *[f"CAST({k} AS VARCHAR)" for k in keys.split(", ")], "b", "j"])
    return f"""
{name}_v AS (SELECT {keys}, metric, list({ON_SCALE} ORDER BY {order}) AS s FROM {rel} WHERE value IS NOT NULL GROUP BY {keys}, metric),
{name}_b AS (SELECT {keys}, metric, s, unnest(range(0, {n})) AS b FROM {name}_v),
{name}_j AS (SELECT {keys}, metric, b, s, unnest(range(1, len(s) + 1)) AS j FROM {name}_b),
{name}_m AS (
  SELECT {keys}, metric, b AS resample, avg(s[('0x' || substr(md5({text}), 1, 15))::BIGINT % len(s) + 1]) AS m
  FROM {name}_j GROUP BY {keys}, metric, b),
{name} AS (SELECT {keys}, metric, resample, CASE WHEN {IS_AREA} THEN {inv_logit("m")} ELSE m END AS average FROM {name}_m)"""


MEANS = f"{AVERAGES}, {means_sql('config_id', 'perf', A.RESAMPLES, 'rep, fold')}"
INTERVALS = f"""{MEANS},
intervals AS (SELECT config_id, metric, quantile_cont(average, 0.025) AS lower95, quantile_cont(average, 0.975) AS upper95 FROM means GROUP BY config_id, metric)"""
BEST = f"""best AS (SELECT config_id FROM averages WHERE metric = 'test_aupvr' ORDER BY average DESC, config_id LIMIT 1)"""
T_TEST = f"""{BEST},
diffs AS (
  SELECT o.config_id, {logit('b.value')} - {logit('o.value')} AS d
  FROM perf o JOIN perf b ON o.rep = b.rep AND o.fold = b.fold AND o.metric = b.metric
  WHERE o.metric = 'test_aupvr' AND b.config_id = (SELECT config_id FROM best) AND o.config_id <> (SELECT config_id FROM best)),
tests AS (SELECT config_id, avg(d) AS mean_difference, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM diffs GROUP BY config_id)"""
# Two-sided tail for odd degrees of freedom (here 9) as a finite sum of cosine powers.
_df = N_REP * N_FOLD - 1
_terms = "1.0"
for _i in range(_df - 2, 1, -2):
    _terms = f"(1.0 + {_i - 1}.0 / {_i}.0 * pow(cos(theta), 2) * {_terms})"
P_VALUE = f"""{T_TEST},
angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS theta FROM tests),
pvalues AS (SELECT *, 1 - 2 / pi() * (theta + sin(theta) * cos(theta) * {_terms}) AS pvalue FROM angles)"""
SET_NAMES = "CASE config_id WHEN 1 THEN 'value_published' WHEN 2 THEN 'negated' ELSE 'hashed' END"


def performance(spark, folder):
    """Long results under the summary names, written once because every summary reads them."""
    long = results_long(results(spark, folder)).where(F.col("metric").isin(list(RENAMED)))
    return cut_lineage(long.replace(RENAMED, subset=["metric"]))


def configurations(spark, folder):
    """The three given scores as configurations with a parameter each."""
    names = F.when(F.col("config_id") == 1, "value_published").otherwise(F.col("set_name"))
    hp = F.create_map(F.lit("scale_pos_weight"), F.col("config_id").cast("double"))
    return given_scores(cases(spark, folder)).select("config_id", names.alias("set_name"), hp_text(hp).alias("hp_text")).distinct()


def reference(averages):
    """The configuration with the best average test area."""
    return averages.where("metric = 'test_aupvr'").orderBy(F.col("average").desc(), "config_id").limit(1)


def by_method(long):
    return long.withColumn("method", F.when(F.col("config_id") <= 2, "raw").otherwise("hash")).withColumnRenamed("config_id", "hp_no")


@query("results_long", f"WITH RECURSIVE {PERF} SELECT config_id, rep, fold, metric, {r6('value', 'value')} FROM perf")
def _(spark, folder):
    return rounded(performance(spark, folder))


_cells = ", ".join(
    f"{r6(f'max(CASE WHEN metric = {chr(39)}{m}{chr(39)} AND rep = {r} AND fold = {f} THEN value END)', f'{m}_{r}_{f}')}"
    for m in NAMES for r in range(1, N_REP + 1) for f in range(1, N_FOLD + 1)
)


@query("wide_results", f"WITH RECURSIVE {PERF} SELECT config_id, {_cells} FROM perf GROUP BY config_id")
def _(spark, folder):
    return rounded(A.wide_results(performance(spark, folder), N_REP, N_FOLD, NAMES))


@query("fold_suffix", f"WITH RECURSIVE {PERF} SELECT DISTINCT metric || '_' || rep || '_' || fold AS slot FROM perf")
def _(spark, folder):
    return performance(spark, folder).select(F.concat_ws("_", "metric", "rep", "fold").alias("slot")).distinct()


@query(
    "logit_mean",
    f"""WITH RECURSIVE {LONG} SELECT config_id, metric, {r6(inv_logit(f"avg({logit('value')})"), 'logit_mean')}
    FROM long WHERE {IS_AREA} GROUP BY config_id, metric""",
)
def _(spark, folder):
    long = results_long(results(spark, folder)).where(F.col("metric").rlike(A.LOGIT_METRICS))
    return rounded(long.groupBy("config_id", "metric").agg(logit_mean("value").alias("logit_mean")))


@query("average_results", f"WITH RECURSIVE {AVERAGES} SELECT config_id, metric, {r6('average', 'average')}, n_values, n_missing FROM averages")
def _(spark, folder):
    return rounded(A.average_results(performance(spark, folder)))


@query("bootstrap_means", f"WITH RECURSIVE {MEANS} SELECT config_id, metric, resample, {r6('average', 'average')} FROM means")
def _(spark, folder):
    out = A.bootstrap_means(performance(spark, folder))
    return rounded(out.withColumn("resample", F.col("resample").cast("bigint")))


@query("bootstrap_ci", f"WITH RECURSIVE {INTERVALS} SELECT config_id, metric, {r6('lower95', 'lower95')}, {r6('upper95', 'upper95')} FROM intervals")
def _(spark, folder):
    return rounded(A.bootstrap_intervals(A.bootstrap_means(performance(spark, folder))))


_best_sql = """{ctes}, m AS (SELECT {method} AS method, config_id AS hp_no, avg(value) AS v FROM perf WHERE metric = '{metric}' GROUP BY ALL),
chosen AS (SELECT method, hp_no, v FROM m QUALIFY row_number() OVER (PARTITION BY method ORDER BY v {order}, hp_no) = 1)"""
BEST_AUPVR = _best_sql.format(ctes=PERF, method=METHOD, metric="test_aupvr", order="DESC")
BEST_AVGRANK = _best_sql.format(ctes=PERF, method=METHOD, metric="test_avgrank", order="ASC")


@query("best_by_aupvr", f"WITH RECURSIVE {BEST_AUPVR} SELECT method, hp_no, {r6('v', 'mean_value')} FROM chosen")
def _(spark, folder):
    return rounded(A.best_configurations(by_method(performance(spark, folder)), "test_aupvr", largest=True))


@query("best_by_avgrank", f"WITH RECURSIVE {BEST_AVGRANK} SELECT method, hp_no, {r6('v', 'mean_value')} FROM chosen")
def _(spark, folder):
    return rounded(A.best_configurations(by_method(performance(spark, folder)), "test_avgrank", largest=False))


@query(
    "rows_of_best",
    f"""WITH RECURSIVE {BEST_AUPVR} SELECT p.config_id AS hp_no, {METHOD} AS method, rep, fold, metric, {r6('value', 'value')} FROM perf p
    WHERE ({METHOD}, p.config_id) IN (SELECT method, hp_no FROM chosen)""",
)
def _(spark, folder):
    long = by_method(performance(spark, folder))
    return rounded(A.rows_of_best(long, A.best_configurations(long, "test_aupvr", largest=True)))


BOOT_BEST = f"""{BEST_AVGRANK},
best_rows AS (SELECT {METHOD} AS method, rep, fold, metric, value FROM perf p
  WHERE ({METHOD}, p.config_id) IN (SELECT method, hp_no FROM chosen) AND metric LIKE 'test%'),
{means_sql('method', 'best_rows', 10000, 'rep, fold')}"""


def best_bootstrap(spark, folder):
    long = by_method(performance(spark, folder))
    best = A.rows_of_best(long, A.best_configurations(long, "test_avgrank", largest=False))
    return A.bootstrap_means(best.where(F.col("metric").startswith("test")).drop("hp_no"), 10_000, keys=["method"])


@query(
    "bootstrap_table",
    f"""WITH RECURSIVE {BOOT_BEST} SELECT method, resample, {", ".join(r6(f"max(CASE WHEN metric = 'test_{m}' THEN average END)", m) for m in ("auroc", "aupvr", "avgrank"))}
    FROM means GROUP BY method, resample""",
)
def _(spark, folder):
    means = best_bootstrap(spark, folder)
    picked = [F.max(F.when(F.col("metric") == f"test_{m}", F.col("average"))).alias(m) for m in ("auroc", "aupvr", "avgrank")]
    return rounded(means.groupBy("method", F.col("resample").cast("bigint").alias("resample")).agg(*picked))


@query(
    "box_stats",
    f"""WITH RECURSIVE {BOOT_BEST}, b AS (SELECT method, metric, quantile_cont(average, 0.25) AS q1, median(average) AS med, quantile_cont(average, 0.75) AS q3 FROM means GROUP BY method, metric),
    x AS (SELECT *, average BETWEEN q1 - 2.5 * (q3 - q1) AND q3 + 2.5 * (q3 - q1) AS inside FROM means JOIN b USING (method, metric))
    SELECT method, metric, {r6('q1', 'q1')}, {r6('med', 'median')}, {r6('q3', 'q3')}, {r6('min(average) FILTER (inside)', 'whisker_low')},
    {r6('max(average) FILTER (inside)', 'whisker_high')}, count(*) FILTER (NOT inside) AS outliers FROM x GROUP BY method, metric, q1, med, q3""",
)
def _(spark, folder):
    return rounded(A.box_statistics(best_bootstrap(spark, folder), ["method", "metric"]))


def tested(long):
    averages = A.average_results(long)
    return A.paired_t(long, reference(averages))


@query("paired_t", f"WITH RECURSIVE {AVERAGES}, {T_TEST} SELECT config_id, {r6('mean_difference', 'mean_difference')}, {r6('t', 't')}, df FROM tests")
def _(spark, folder):
    return rounded(tested(performance(spark, folder)))


@query("paired_p", f"WITH RECURSIVE {AVERAGES}, {P_VALUE} SELECT config_id, {r6('t', 't')}, df, {r6('pvalue', 'pvalue')} FROM pvalues")
def _(spark, folder):
    return rounded(A.with_p_value(tested(performance(spark, folder))).select("config_id", "t", "df", "pvalue"))


def final(spark, folder, wide=False):
    long = performance(spark, folder)
    averages = A.average_results(long)
    intervals = A.bootstrap_intervals(A.bootstrap_means(long))
    tests = A.with_p_value(A.paired_t(long, reference(averages)))
    values = A.wide_results(long, N_REP, N_FOLD, NAMES) if wide else None
    return A.final_table(configurations(spark, folder), averages, intervals, tests, NAMES, wide=values)


def _wide_cols(rel: str, prefix: str, value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {value} END) AS {prefix}{m}" for m in NAMES)
    return f"SELECT config_id, {cols} FROM {rel} GROUP BY config_id"


FINAL = f"""{INTERVALS}, {P_VALUE}, final AS (
  SELECT a.*, {SET_NAMES} AS set_name, 'scale_pos_weight=' || CAST(config_id::DOUBLE AS VARCHAR) AS hp_text,
  l.* EXCLUDE (config_id), u.* EXCLUDE (config_id), pvalue
  FROM ({_wide_cols('averages', 'avg_', 'average')}) a JOIN ({_wide_cols('intervals', 'lower_95ci_', 'lower95')}) l USING (config_id)
  JOIN ({_wide_cols('intervals', 'upper_95ci_', 'upper95')}) u USING (config_id) LEFT JOIN pvalues USING (config_id))"""
_final_cols = ", ".join(r6(f"{p}{m}", f"{p}{m}") for p in ("avg_", "lower_95ci_", "upper_95ci_") for m in NAMES)


@query(
    "final_table",
    f"""WITH RECURSIVE {FINAL}, w AS (SELECT config_id, {_cells} FROM perf GROUP BY config_id)
    SELECT config_id, set_name, hp_text, {_final_cols}, {r6('pvalue', 'pvalue')}, w.* EXCLUDE (config_id) FROM final JOIN w USING (config_id)""",
)
def _(spark, folder):
    return rounded(final(spark, folder, wide=True))


TEST_NAMES = [m for m in NAMES if m.startswith("test_")]
PLOT = f"""{FINAL}, plot AS ({" UNION ALL ".join(
    f"SELECT config_id, set_name, hp_text, '{m.removeprefix('test_').upper()}' AS metric, avg_{m} AS value, lower_95ci_{m} AS lower95, upper_95ci_{m} AS upper95 FROM final"
    for m in TEST_NAMES)})"""
_plot_cols = f"{r6('value', 'value')}, {r6('lower95', 'lower95')}, {r6('upper95', 'upper95')}"


@query("plot_long", f"WITH RECURSIVE {PLOT} SELECT config_id, set_name, hp_text, metric, {_plot_cols} FROM plot")
def _(spark, folder):
    return rounded(A.plot_rows(final(spark, folder), TEST_NAMES))


@query(
    "plot_selection",
    f"""WITH RECURSIVE {PLOT} SELECT config_id, set_name, hp_text, metric, {_plot_cols} FROM plot
    WHERE set_name NOT IN ('value_published', 'negated') OR contains(hp_text, 'scale_pos_weight=1')""",
)
def _(spark, folder):
    rows = A.plot_rows(final(spark, folder), TEST_NAMES)
    return rounded(A.plot_selection(rows, ["value_published", "negated"]))


@query(
    "plot_labels",
    f"""WITH RECURSIVE {PLOT} SELECT config_id, replace(set_name, '_published', '') AS set_name, hp_text, metric, {_plot_cols},
    CAST(row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'AVGRANK' THEN -value ELSE value END, config_id) AS INTEGER) AS place FROM plot""",
)
def _(spark, folder):
    return rounded(A.plot_labels(A.plot_rows(final(spark, folder), TEST_NAMES)))


SCATTER = f"{AVERAGES}, f AS ({_wide_cols('averages', 'avg_', 'average')})"


@query("scatter", f"WITH RECURSIVE {SCATTER} SELECT config_id, {r6('avg_test_avgrank', 'avg_test_avgrank')}, {r6('avg_test_aupvr', 'avg_test_aupvr')} FROM f")
def _(spark, folder):
    wide = A.averages_wide(A.average_results(performance(spark, folder)), NAMES)
    return rounded(A.scatter(wide))


@query(
    "scatter_zoom",
    f"""WITH RECURSIVE {SCATTER} SELECT config_id, {r6('avg_test_avgrank', 'avg_test_avgrank')}, {r6('avg_test_aupvr', 'avg_test_aupvr')} FROM f
    WHERE avg_test_avgrank <= 4.75 AND avg_test_aupvr >= 0.4""",
)
def _(spark, folder):
    wide = A.averages_wide(A.average_results(performance(spark, folder)), NAMES)
    return rounded(A.scatter(wide, max_avgrank=4.75, min_aupvr=0.4))


@query("distinct_configurations", f"WITH RECURSIVE {LONG} SELECT DISTINCT config_id FROM results")
def _(spark, folder):
    return A.distinct_configurations(results(spark, folder))


@query(
    "results_by_set",
    f"""WITH RECURSIVE {LONG} SELECT config_id, rep, fold, 'given' AS set_type, CASE config_id WHEN 1 THEN 'value' WHEN 2 THEN 'negated' ELSE 'hashed' END AS set_name,
    {", ".join(r6(m, m) for m in RESULT_METRICS)} FROM results""",
)
def _(spark, folder):
    from lociq.plans.validation import partition_by_set

    configs = given_scores(cases(spark, folder)).select("config_id", F.lit("given").alias("set_type"), "set_name").distinct()
    return rounded(partition_by_set(results(spark, folder), configs))
