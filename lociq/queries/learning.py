"""Objectives, boosting, forests and reducers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions.draws import hash_bits, uniform
from lociq.operators import boost as B
from lociq.operators import forest as S
from lociq.operators import metrics as M
from lociq.operators import objective as O
from lociq.operators import reduce as R
from lociq.operators.cuts import exact_quantiles
from lociq.operators.folds import grouped_folds
from lociq.operators.quality import class_balance
from lociq.operators.scoring import METRICS
from lociq.plans import runner as RUN
from lociq.plans.configurations import objective_grid
from lociq.plans.tuning import tune
from lociq.queries import query, rounded
from lociq.queries.boosting import bins_sql, boost_sql, cuts_sql, settings_sql
from lociq.queries.loci import kept
from lociq.queries.sql import AUROC, KEPT, STEP, bits, dg, draw, grouped, points, r6, ranks
from lociq.session import cut_lineage
from lociq.sources.fixtures import cases, embedding_features, given_scores, table

# Predictions of three tasks, each with its own bandwidth.
PREDS = f"""{KEPT}, bands(task_id, bandwidth) AS (VALUES (1, 0.1::DOUBLE), (2, 0.5::DOUBLE), (3, 1.0::DOUBLE)),
preds AS (SELECT task_id, bandwidth, case_id, locus_id, label, 4 * {draw("task_id || '|' || case_id")} - 2 AS pred FROM kept, bands)"""


def predictions(spark, folder):
    bands = F.array(*[F.struct(F.lit(i + 1).alias("task_id"), F.lit(b).alias("bandwidth")) for i, b in enumerate((0.1, 0.5, 1.0))])
    rows = kept(spark, folder).select("case_id", "locus_id", "label", F.explode(bands).alias("_b")).select("*", "_b.*").drop("_b")
    return rows.withColumn("pred", 4 * uniform("task_id", "case_id") - 2)


@query(
    "rank_objective",
    f"""WITH {PREDS}, pairs AS (
      SELECT a.task_id, a.case_id, a.label, a.bandwidth AS b, abs(a.pred - o.pred) AS d, exp(-pow(a.pred - o.pred, 2) / pow(a.bandwidth, 2)) / (a.bandwidth * sqrt(pi())) AS k
      FROM preds a JOIN preds o ON a.task_id = o.task_id AND a.locus_id = o.locus_id AND a.label <> o.label),
    sums AS (SELECT task_id, case_id, CASE WHEN any_value(label) = 1 THEN -1 ELSE 1 END * sum(k) AS grad, 2 / pow(any_value(b), 2) * sum((d + b) * k) AS hess
      FROM pairs GROUP BY task_id, case_id)
    SELECT p.task_id, p.case_id, {r6("coalesce(grad, 1 / (1 + exp(-pred)) - label)", "grad")},
    {r6("coalesce(hess, 1 / (1 + exp(-pred)) * (1 - 1 / (1 + exp(-pred))))", "hess")}
    FROM preds p LEFT JOIN sums s ON p.task_id = s.task_id AND p.case_id = s.case_id""",
)
def _(spark, folder):
    out = O.rank_objective(predictions(spark, folder), ["task_id"], "bandwidth")
    return rounded(out.select("task_id", "case_id", "grad", "hess"))


@query(
    "logistic_objective",
    f"""WITH {PREDS} SELECT task_id, case_id, {r6("1 / (1 + exp(-pred)) - label", "grad")},
    {r6("1 / (1 + exp(-pred)) * (1 - 1 / (1 + exp(-pred)))", "hess")} FROM preds""",
)
def _(spark, folder):
    return rounded(O.logistic_objective(predictions(spark, folder)).select("task_id", "case_id", "grad", "hess"))


@query(
    "weighted_objective",
    f"""WITH {PREDS} SELECT task_id, case_id, {r6("CASE WHEN label = 1 THEN 0.5 ELSE 1 END * (pred - label)", "grad")}, 1.0::DOUBLE AS hess FROM preds""",
)
def _(spark, folder):
    return rounded(O.weighted_squared_objective(predictions(spark, folder)).select("task_id", "case_id", "grad", "hess"))


# The features of an event in SQL.
EVENT_VALUES = "[value, hour(ts)::DOUBLE, ((dayofweek(ts) + 6) % 7)::DOUBLE, CAST(json_extract_string(props, '$.k') AS DOUBLE)]"


def event_features(spark, folder):
    """Numbers of every event: value, hour of day, weekday, and the number in its properties (missing for some)."""
    hour, day = F.hour("ts").cast("double"), F.weekday("ts").cast("double")
    number = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(F.col("event_id").alias("case_id"), F.array(F.col("value"), hour, day, number).alias("features"))


# Twelve tasks on the embeddings: three folds by four parameter points; cut points are the same for every feature.
CUTS = [-0.2, -0.1, 0.0, 0.1, 0.2]
POINTS = [
    {"eta": 0.1, "nrounds": 2, "lambda": 1.0, "max_depth": 2},
    {"eta": 0.3, "nrounds": 2, "lambda": 0.1, "max_depth": 3, "gamma": 0.1},
    {"eta": 0.1, "nrounds": 2, "lambda": 10.0, "alpha": 0.5, "scale_pos_weight": 2, "max_depth": 2},
    {"eta": 0.1, "nrounds": 2, "subsample": 0.85, "colsample_bytree": 0.5, "base_score": 0.4, "max_depth": 3},
]


def boost_tasks(spark, folder, points=POINTS):
    """(tasks with parameter map, cases with bins, members) on the whole embeddings table: three folds for each point."""
    rows = B.binned(embedding_features(spark, folder), [CUTS] * 64)
    maps = F.array(*[F.create_map(*[F.lit(x) for k, v in p.items() for x in (k, float(v))]) for p in points])
    tasks = spark.range(1, 3 * len(points) + 1).select(F.col("id").cast("int").alias("task_id"))
    fold = F.pmod(hash_bits(1337, "case_id"), F.lit(3)) + 1
    each = rows.select("case_id", fold.alias("fold"), F.explode(F.sequence(F.lit(1), F.lit(3 * len(points)))).alias("task_id"))
    role = F.when(F.pmod(F.col("task_id") - 1, F.lit(3)) + 1 == F.col("fold"), "test").otherwise("train")
    point = (F.floor((F.col("task_id") - 1) / 3) + 1).cast("int")
    return tasks.withColumn("hp", F.element_at(maps, point)), rows, each.select("task_id", "case_id", role.alias("role"))


def boosted(spark, folder, points=POINTS):
    tasks, rows, members = boost_tasks(spark, folder, points)
    return B.newton_boost(rows, members, B.task_settings(tasks), [CUTS] * 64)


def boosted_sql(points, rounds, depth):
    """CTEs of the tasks above: settings, rows and all trees."""
    return f"""WITH settings AS MATERIALIZED ({settings_sql(points, 3)}),
    e AS (SELECT vec_id AS case_id, CAST(label >= 5 AS INTEGER) AS label, embedding::DOUBLE[] AS x FROM embeddings),
    rows AS MATERIALIZED (SELECT task_id, case_id, NULL AS locus_id, CASE WHEN (task_id - 1) % 3 = {bits("'1337|' || case_id")} % 3 THEN 'test' ELSE 'train' END AS role, label,
      {bins_sql("x", f"list_transform(range(64), lambda i: {CUTS}::DOUBLE[])")} AS bins FROM e, settings),
    {boost_sql("rows", "settings", 64, rounds, depth)}"""


BOOSTED = boosted_sql(POINTS, 2, 3)
# Root splits alone, without sampling.
ROOTS = [{k: v for k, v in p.items() if k not in ("subsample", "colsample_bytree")} | {"nrounds": 1, "max_depth": 1} for p in POINTS]
IMPORTANCE_SQL = f"""task_id, feature, {r6("sum(gain) / sum(sum(gain)) OVER t", "gain")}, {r6("sum(cover) / sum(sum(cover)) OVER t", "cover")},
    {r6("count(*) / sum(count(*)) OVER t", "frequency")}"""


@query(
    "split_table",
    f"""{boosted_sql(ROOTS, 1, 1)} SELECT task_id, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, {r6("gain", "gain")}, {r6("cover", "cover")} FROM b_splits""",
)
def _(spark, folder):
    splits = boosted(spark, folder, ROOTS).splits
    return rounded(splits.select("task_id", F.col("feature").cast("int").alias("feature"), F.col("bin").cast("int").alias("bin"), "gain", "cover"))


@query(
    "boost_splits",
    f"""{BOOSTED} SELECT task_id, CAST(tree AS INTEGER) AS tree, node, feature, CAST(bin AS BIGINT) AS bin, {r6("gain", "gain")}, {r6("cover", "cover")} FROM b_splits""",
)
def _(spark, folder):
    return rounded(boosted(spark, folder).splits.drop("missing_left"))


@query("newton_boost", f"{BOOSTED} SELECT task_id, case_id, role, label, {r6('margin', 'margin')}, {r6('score', 'score')} FROM b_scores")
def _(spark, folder):
    return rounded(boosted(spark, folder).scores.select("task_id", "case_id", "role", "label", "margin", "score"))


@query(
    "newton_boost_metrics",
    f"""{BOOSTED}, {points("b_scores", ["task_id", "role"])}, {dg("points", ["task_id", "role"], "dg")},
    areas AS (SELECT task_id, role, {AUROC} AS auroc, {STEP} AS aupvr_step, CAST(max(pos) AS BIGINT) AS positives, CAST(max(neg) AS BIGINT) AS negatives FROM points GROUP BY task_id, role)
    SELECT task_id, role, {r6("auroc", "auroc")}, {r6("aupvr_step", "aupvr_step")}, {r6("aupvr_dg", "aupvr_dg")}, positives, negatives FROM areas LEFT JOIN dg USING (task_id, role)""",
)
def _(spark, folder):
    return rounded(M.evaluate(boosted(spark, folder).scores, ["task_id", "role"], grouped=False))


@query("boost_importance", f"{BOOSTED} SELECT {IMPORTANCE_SQL} FROM b_splits GROUP BY task_id, feature WINDOW t AS (PARTITION BY task_id)")
def _(spark, folder):
    return rounded(B.split_importance(boosted(spark, folder).splits))


@query(
    "quantile_cuts",
    f"""WITH e AS (SELECT embedding::DOUBLE[] AS x FROM embeddings), {cuts_sql("e", 64, 16)},
    events_x AS (SELECT {EVENT_VALUES} AS x FROM events), {cuts_sql("events_x", 4, 16, name="more")}
    SELECT 'embeddings' AS source, CAST(f - 1 AS INTEGER) AS feature, CAST(i AS INTEGER) AS i, v AS cut FROM cuts_q
    UNION ALL SELECT 'events', CAST(f - 1 AS INTEGER), CAST(i AS INTEGER), v FROM more_q""",
)
def _(spark, folder):
    found = {"embeddings": exact_quantiles(embedding_features(spark, folder), 64, 16), "events": exact_quantiles(event_features(spark, folder), 4, 16)}
    rows = [(s, f, i + 1, v) for s, features in found.items() for f, values in enumerate(features) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "source string, feature int, i int, cut double")


def embedding_members(spark, folder):
    """Embeddings in two tasks: halves by hash, each trained on one half."""
    cases = embedding_features(spark, folder).withColumn("half", F.pmod(hash_bits(1337, "case_id"), F.lit(2)) + 1)
    rows = cases.withColumn("task_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.withColumn("role", F.when(F.col("half") == F.col("task_id"), "test").otherwise("train")).drop("half")


# Weights, scores and deflation of both components written out over (task, case, feature) rows.
PLS = f"""WITH e AS (SELECT vec_id AS case_id, CAST(label >= 5 AS INTEGER) AS label, embedding::DOUBLE[] AS x,
      {bits("'1337|' || vec_id")} % 2 + 1 AS half FROM embeddings),
    m AS (SELECT e.*, task_id, half <> task_id AS tr FROM e, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS task_id)),
    v AS (SELECT task_id, case_id, label, tr, unnest(range(0, 64)) AS f, unnest(x) AS val FROM m),
    mean AS (SELECT task_id, f, avg(val) AS mu FROM v WHERE tr GROUP BY ALL),
    ym AS (SELECT task_id, avg(label) AS ym FROM m WHERE tr GROUP BY ALL),
    c AS (SELECT v.task_id, case_id, tr, f, val - mu AS x, label - ym AS y FROM v JOIN mean USING (task_id, f) JOIN ym USING (task_id)),
    s1 AS (SELECT task_id, f, sum(x * y) AS s FROM c WHERE tr GROUP BY ALL),
    w1 AS (SELECT task_id, f, s / sqrt(sum(s * s) OVER (PARTITION BY task_id)) AS w FROM s1),
    t1 AS (SELECT task_id, case_id, any_value(tr) AS tr, sum(x * w) AS t FROM c JOIN w1 USING (task_id, f) GROUP BY task_id, case_id),
    p1 AS (SELECT c.task_id, f, sum(x * t) / (SELECT sum(t * t) FROM t1 q WHERE q.tr AND q.task_id = c.task_id) AS p
      FROM c JOIN t1 USING (task_id, case_id) WHERE c.tr GROUP BY c.task_id, f),
    d AS (SELECT task_id, case_id, c.tr, f, x - t * p AS x, y FROM c JOIN t1 USING (task_id, case_id) JOIN p1 USING (task_id, f)),
    s2 AS (SELECT task_id, f, sum(x * y) AS s FROM d WHERE tr GROUP BY ALL),
    w2 AS (SELECT task_id, f, s / sqrt(sum(s * s) OVER (PARTITION BY task_id)) AS w FROM s2),
    t2 AS (SELECT task_id, case_id, sum(x * w) AS t FROM d JOIN w2 USING (task_id, f) GROUP BY task_id, case_id)"""


@query(
    "pls_scores",
    f"""{PLS} SELECT t1.task_id, t1.case_id, {r6("t1.t", "first")}, {r6("t2.t", "second")}
    FROM t1 JOIN t2 ON t1.task_id = t2.task_id AND t1.case_id = t2.case_id""",
)
def _(spark, folder):
    out = R.pls_scores(embedding_members(spark, folder), 2)
    return rounded(out.select("task_id", "case_id", F.col("pls")[0].alias("first"), F.col("pls")[1].alias("second")))


def one_task(spark, folder):
    return embedding_members(spark, folder).where("task_id = 1")


@query("gbt_scores")
def _(spark, folder):
    scored, _ = S.boosted_scores(one_task(spark, folder), {"eta": 0.1, "nrounds": 5, "max_depth": 3, "scale_pos_weight": 2})
    return scored.select("case_id", "role", "label", "score")


@query("forest_probability")
def _(spark, folder):
    scored, _ = S.forest_scores(one_task(spark, folder), {"num_trees": 20, "mtry": 14, "max_depth": 5})
    return scored.select("case_id", "role", "label", "score")


@query("forest_votes")
def _(spark, folder):
    hp = {"num_trees": 20, "mtry": 14, "max_depth": 5, "weight_positive_class": 8}
    scored, _ = S.forest_scores(one_task(spark, folder), hp, votes=True)
    return scored.select("case_id", "role", "label", "score")


@query("forest_importance")
def _(spark, folder):
    _, found = S.forest_scores(one_task(spark, folder), {"num_trees": 20, "mtry": 14, "max_depth": 5})
    return S.collect_importance({(1, 1, 1): found})


@query("gbt_metrics")
def _(spark, folder):
    scored, _ = S.boosted_scores(one_task(spark, folder), {"eta": 0.1, "nrounds": 5, "max_depth": 3})
    return M.evaluate(scored, ["task_id", "role"], grouped=False)


CONFIGS = [
    (1, "passthrough", "value", "value", None, None, None, None),
    (2, "XGB", "boosted", "XGB", "events", {"eta": 0.3, "nrounds": 1.0, "max_depth": 2.0, "base_score": 0.5}, None, None),
    (3, "XGB", "boosted_reduced", "XGB", "events", {"eta": 0.3, "nrounds": 1.0, "max_depth": 1.0}, "counts", 1),
]


# One replication of two folds of the kept events, with their features.
EVENTS = f"""{grouped(1, 2)},
    ev AS MATERIALIZED (SELECT k.case_id, k.locus_id, k.label, g.fold, k.score AS value, {EVENT_VALUES} AS x FROM kept k JOIN grouped g ON g.case_id = k.case_id JOIN events ON event_id = k.case_id)"""
_role = "CASE WHEN fold = (task_id - 1) % 2 + 1 THEN 'test' ELSE 'train' END AS role"
# From scored members (task_id, case_id, locus_id, role, label, score) to one row of metrics for each task.
_picked = ", ".join(r6(f"max(CASE WHEN role = '{r}' THEN {m} END)", f"{r}_{m}") for r in ("train", "test") for m in METRICS)
MEASURED = f"""{points("members", ["task_id", "role"])}, {dg("points", ["task_id", "role"], "dg")}, {ranks("members", ["task_id", "role"], "rk")},
    areas AS (SELECT task_id, role, {AUROC} AS auroc, {STEP} AS aupvr_step FROM points GROUP BY task_id, role),
    measured AS (SELECT task_id, {_picked} FROM areas LEFT JOIN dg USING (task_id, role) LEFT JOIN rk USING (task_id, role) GROUP BY task_id)"""
_points = [c[5] for c in CONFIGS]
_listed = ", ".join(
    f"({c}, '{t}', '{n}', '{m}', {'NULL' if x is None else repr(x)}, {'NULL' if r is None else repr(r)}, {'NULL' if k is None else k})" for c, t, n, m, x, _, r, k in CONFIGS
)
RUNS = f"""WITH RECURSIVE {EVENTS}, {cuts_sql("ev", 4, 8, name="c2")}, set2 AS MATERIALIZED ({settings_sql([_points[1]], 2)}),
    rows2 AS MATERIALIZED (SELECT task_id, case_id, locus_id, {_role}, label, {bins_sql("x", "cuts")} AS bins FROM ev, set2, c2), {boost_sql("rows2", "set2", 4, 1, 2, "b2")},
    pv AS (SELECT v AS variant, case_id, label, fold <> v AS tr, unnest([1, 2, 3]) AS f, unnest(x[1:3]) AS z FROM ev, (SELECT unnest([1, 2]) AS v)),
    pm AS (SELECT variant, f, avg(z) AS mu, avg(label) AS ym FROM pv WHERE tr GROUP BY variant, f),
    ps AS (SELECT variant, f, any_value(mu) AS mu, sum((z - mu) * (label - ym)) AS s FROM pv JOIN pm USING (variant, f) WHERE tr GROUP BY variant, f),
    pw AS (SELECT variant, f, mu, s / sqrt(sum(s * s) OVER (PARTITION BY variant)) AS w FROM ps),
    pt AS (SELECT variant, case_id, sum((z - mu) * w ORDER BY f) AS t FROM pv JOIN pw USING (variant, f) GROUP BY variant, case_id),
    ev3 AS MATERIALIZED (SELECT variant, ev.* REPLACE (list_append(x, t) AS x) FROM ev JOIN pt USING (case_id)), {cuts_sql("ev3", 5, 8, name="c3")}, set3 AS MATERIALIZED ({settings_sql([_points[2]], 2)}),
    rows3 AS MATERIALIZED (SELECT task_id, case_id, locus_id, {_role}, label, {bins_sql("x", "cuts")} AS bins FROM ev3 JOIN set3 ON task_id = variant, c3), {boost_sql("rows3", "set3", 5, 1, 1, "b3")},
    members AS (SELECT task_id, case_id, locus_id, {_role}, label, value AS score FROM ev, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS task_id)
      UNION ALL SELECT task_id + 2, case_id, locus_id, role, label, score FROM b2_scores UNION ALL SELECT task_id + 4, case_id, locus_id, role, label, score FROM b3_scores),
    {MEASURED}, listed(config_id, set_type, set_name, method, matrix, reducer_matrix, reducer_components) AS (VALUES {_listed}),
    tasks AS (SELECT listed.*, 1 AS rep, CAST(fold AS INTEGER) AS fold, CAST(fold AS INTEGER) AS fold_index, CAST((config_id - 1) * 2 + fold AS BIGINT) AS task_id FROM listed, (SELECT unnest([1, 2]) AS fold))"""


def run_all(spark, folder):
    rows = kept(spark, folder).drop("score")
    scores = given_scores(cases(spark, folder))
    configs = spark.createDataFrame(
        CONFIGS,
        "config_id int, set_type string, set_name string, method string, matrix string, hp map<string,double>, reducer_matrix string, reducer_components int",
    )
    features = event_features(spark, folder)
    complete = features.withColumn("features", F.slice("features", 1, 3))
    scorers = {
        "value": RUN.given(scores.where("set_name = 'value'")),
        "XGB": RUN.boosted(n_bins=8),
    }
    rows = cut_lineage(rows)
    folds = cut_lineage(grouped_folds(rows, 1, 2))
    return RUN.run_configurations(configs, rows, folds, scorers, {"events": features, "counts": complete}, 1, 2)


@query("run_configurations", f"{RUNS} SELECT tasks.*, measured.* EXCLUDE (task_id), 0::BIGINT AS nan_scores FROM tasks JOIN measured USING (task_id)")
def _(spark, folder):
    results, _ = run_all(spark, folder)
    return rounded(results.drop("hp", "run_time"))


@query(
    "importance_long",
    f"""{RUNS}, found AS (SELECT {IMPORTANCE_SQL} FROM (SELECT * REPLACE (task_id + 2 AS task_id) FROM b2_splits UNION ALL SELECT * REPLACE (task_id + 4 AS task_id) FROM b3_splits)
      GROUP BY task_id, feature WINDOW t AS (PARTITION BY task_id))
    SELECT config_id, set_type, set_name, rep, fold, feature, gain AS importance, cover, frequency FROM found JOIN tasks USING (task_id)""",
)
def _(spark, folder):
    return rounded(run_all(spark, folder)[1])


# Two grid points with the default objective, and the same with the rank objective and a bandwidth each.
TUNED_VALUES = {"eta": [0.3], "nrounds": [2], "lambda": [1.0, 5.0], "min_child_weight": [0.5], "max_depth": [2]}
TUNED_BANDWIDTHS = [{"bandwidth": 0.5}, {"bandwidth": 2.0}]
_grid = [{"eta": 0.3, "nrounds": 2, "lambda": x, "min_child_weight": 0.5, "max_depth": 2, "base_score": "(SELECT fp FROM bal)"} for x in (1.0, 5.0)]
TUNING = f"""WITH RECURSIVE {EVENTS}, bal AS (SELECT sum(label) / count(*) AS fp FROM kept), {cuts_sql("ev", 4, 8)},
    settings AS MATERIALIZED ({settings_sql([*_grid, *[p | b for p, b in zip(_grid, TUNED_BANDWIDTHS, strict=True)]], 2)}),
    rows AS MATERIALIZED (SELECT task_id, case_id, locus_id, {_role}, label, {bins_sql("x", "cuts")} AS bins FROM ev, settings, cuts), {boost_sql("rows", "settings", 4, 2, 2)},
    members AS (SELECT * FROM b_scores), {MEASURED},
    tuned AS (SELECT CASE WHEN task_id <= 4 THEN 'main_XGB' ELSE 'main_XGB_custom' END AS set_name, CAST((task_id - 1) // 2 % 2 + 1 AS BIGINT) AS hp_no, CAST((task_id - 1) % 2 + 1 AS INTEGER) AS fold,
      bandwidth, base_score, measured.* EXCLUDE (task_id) FROM measured JOIN settings USING (task_id))"""


def tuned(spark, folder):
    rows = cut_lineage(kept(spark, folder).drop("score"))
    configs = cut_lineage(objective_grid(class_balance(rows), TUNED_VALUES, TUNED_BANDWIDTHS))
    return tune(configs, rows, cut_lineage(grouped_folds(rows, 1, 2)), event_features(spark, folder), 1, 2, n_bins=8)


@query("tune_rank_objective", f"{TUNING} SELECT * REPLACE ({r6('base_score', 'base_score')}) FROM tuned")
def _(spark, folder):
    measures = [f"{r}_{m}" for r in ("train", "test") for m in METRICS]
    return rounded(tuned(spark, folder).results.select("set_name", "hp_no", "fold", F.col("hp")["bandwidth"].alias("bandwidth"), F.col("hp")["base_score"].alias("base_score"), *measures))


@query(
    "tune_rank_best",
    f"""{TUNING}, means AS (SELECT set_name, hp_no, avg(test_aupvr_dg) AS a, avg(test_avgrank_neg) AS r FROM tuned GROUP BY ALL),
    picks AS (SELECT 'aupvr' AS measure, set_name, hp_no, a AS mean_value, row_number() OVER (PARTITION BY set_name ORDER BY a DESC, hp_no) AS i FROM means
      UNION ALL SELECT 'avgrank', set_name, hp_no, r, row_number() OVER (PARTITION BY set_name ORDER BY r, hp_no) FROM means)
    SELECT measure, set_name, hp_no, CAST(round(mean_value, 4) AS DOUBLE) AS mean_value FROM picks WHERE i = 1""",
)
def _(spark, folder):
    out = tuned(spark, folder)
    both = out.best_aupvr.withColumn("measure", F.lit("aupvr")).unionByName(out.best_avgrank.withColumn("measure", F.lit("avgrank")))
    return rounded(both.select("measure", "set_name", "hp_no", "mean_value"), 4)
