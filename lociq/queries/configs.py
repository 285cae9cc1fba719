"""Grids, configurations and tasks. Parameter lists are fixed values; class weights come from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions.scalars import hp_text
from lociq.operators import tasks as T
from lociq.operators.quality import class_balance
from lociq.plans import configurations as C
from lociq.queries import query, rounded
from lociq.queries.sql import CASES, N_FOLD, N_REP, RESULTS, bits, r6
from lociq.queries.metrics import results
from lociq.sources.fixtures import cases

BALANCE = f"{CASES}, bal AS (SELECT sum(label) / count(*) AS fp, sum(1 - label) / sum(label) AS np FROM cases)"


def grid_sql(values: dict[str, list | str]) -> str:
    """Nested loops over the lists, last one fastest; a text is a list expression with one entry."""
    lists, number, stride = [], [], 1
    for k, (name, v) in reversed(list(enumerate(values.items()))):
        array = v if isinstance(v, str) else str([float(x) for x in v])
        lists.append(f"(SELECT unnest({array}::DOUBLE[]) AS \"{name}\", generate_subscripts({array}, 1) AS i{k}) g{k}")
        number.append(f"(i{k} - 1) * {stride}")
        stride *= 1 if isinstance(v, str) else len(v)
    names = ", ".join(f'"{n}"' for n in values)
    return f"SELECT CAST(1 + {' + '.join(number)} AS BIGINT) AS hp_no, {names} FROM {', '.join(lists)}"


# The one data-driven parameter: the fraction of positives as the starting score.
TUNING = f"WITH {BALANCE}, grid AS ({grid_sql({**C.TUNING_GRID, 'base_score': '[(SELECT fp FROM bal)]'})})"
NAMES = [*C.TUNING_GRID, "base_score"]
QUOTE = '"{}"'
_text = " || ', ' || ".join(f"'{n}=' || CAST(\"{n}\" AS VARCHAR)" for n in sorted(NAMES))


def tuning(spark, folder):
    return C.tuning_grid(class_balance(cases(spark, folder)))


@query("hp_grid", f"{TUNING} SELECT hp_no, {', '.join(r6(QUOTE.format(n), QUOTE.format(n)) for n in NAMES)} FROM grid")
def _(spark, folder):
    points = tuning(spark, folder)
    return rounded(points.select("hp_no", *[F.col("hp")[n].alias(n) for n in NAMES]))


@query("hp_text", f"{TUNING.replace('(SELECT fp FROM bal)', '(SELECT round(fp, 4) FROM bal)')} SELECT hp_no, {_text} AS hp_text FROM grid")
def _(spark, folder):
    short = class_balance(cases(spark, folder)).withColumn("fraction_positive", F.round("fraction_positive", 4))
    return C.tuning_grid(short).select("hp_no", hp_text("hp").alias("hp_text"))


@query(
    "hp_zip",
    f"{TUNING} SELECT hp_no, eta, gamma, list_extract([0.1, 0.5, 1.0]::DOUBLE[], (hp_no - 1) % 3 + 1) AS bandwidth, {r6('base_score', 'base_score')} FROM grid",
)
def _(spark, folder):
    paired = T.pair_parameters(tuning(spark, folder), C.BANDWIDTHS)
    return rounded(paired.select("hp_no", F.col("hp")["eta"].alias("eta"), F.col("hp")["gamma"].alias("gamma"), "bandwidth", F.col("hp")["base_score"].alias("base_score")))


@query("hp_product", f"{TUNING} SELECT hp_no, bandwidth, {r6('base_score', 'base_score')} FROM grid, (SELECT unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS bandwidth)")
def _(spark, folder):
    paired = T.pair_parameters(tuning(spark, folder), C.BANDWIDTHS, how="product")
    return rounded(paired.select("hp_no", "bandwidth", F.col("hp")["base_score"].alias("base_score")))


# The comparison's configurations as (family order, set type, set name, matrix, method, points).
_rows = ", ".join(
    f"('{c['set_type']}', '{c['set_name']}', {'NULL' if c['matrix'] is None else repr(c['matrix'])}, '{c['method']}', {i + 1})"
    for c in C.COMPARISON
    for i in range(len(c["points"]) or 1)
)
CONFIGS = f"""WITH {BALANCE}, listed(set_type, set_name, matrix, method, hp_no) AS (VALUES {_rows}),
configs AS (SELECT row_number() OVER (ORDER BY set_type, set_name, hp_no) AS config_id, * FROM listed)"""


def comparison(spark, folder):
    return C.comparison(class_balance(cases(spark, folder)))


@query(
    "configurations",
    f"""{CONFIGS} SELECT CAST(config_id AS INTEGER) AS config_id, set_type, set_name, matrix, method, CAST(hp_no AS BIGINT) AS hp_no,
    CASE WHEN method = 'XGB' AND set_type = 'XGB' THEN round(fp, 6) END AS base_score FROM configs, bal""",
)
def _(spark, folder):
    out = comparison(spark, folder).withColumn("base_score", F.col("hp")["base_score"])
    return rounded(out.select("config_id", "set_type", "set_name", "matrix", "method", "hp_no", "base_score"))


@query(
    "configurations_shuffled",
    f"""{CONFIGS} SELECT CAST(config_id AS INTEGER) AS config_id, {r6('fp', 'fraction_positive')},
    CAST(row_number() OVER (ORDER BY {bits("'1337|' || config_id")}, config_id) AS INTEGER) AS run_order FROM configs, bal""",
)
def _(spark, folder):
    share = class_balance(cases(spark, folder)).select("fraction_positive").scalar()
    out = T.shuffle_configurations(comparison(spark, folder), 1337)
    return rounded(out.select("config_id", share.alias("fraction_positive"), "run_order"))


@query(
    "task_pool",
    f"""{CONFIGS}, reps AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS rep), folds AS (SELECT CAST(unnest(range(1, {N_FOLD + 1})) AS INTEGER) AS fold)
    SELECT row_number() OVER (ORDER BY config_id, rep, fold) AS task_id, CAST(config_id AS INTEGER) AS config_id, set_name, rep, fold,
    (rep - 1) * {N_FOLD} + fold AS fold_index, {r6('fp', 'fraction_positive')} FROM configs, reps, folds, bal""",
)
def _(spark, folder):
    share = class_balance(cases(spark, folder)).select("fraction_positive").scalar()
    out = T.task_table(comparison(spark, folder), 3, N_FOLD).withColumn("fraction_positive", share)
    return rounded(out.select("task_id", "config_id", "set_name", "rep", "fold", "fold_index", "fraction_positive"))


@query("unresolved_names", "SELECT DISTINCT lang AS matrix FROM documents WHERE lang NOT IN ('en', 'de')")
def _(spark, folder):
    wanted = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("lang").alias("matrix"))
    return T.unresolved_names(wanted, "matrix", {"en": 1, "de": 2}, spark)


@query(
    "write_back",
    f"""WITH RECURSIVE {RESULTS}, more AS (SELECT CAST(unnest(range(1, {N_REP + 2})) AS INTEGER) AS rep2), nos AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS config_id2)
    SELECT CAST((config_id2 - 1) * {(N_REP + 1) * N_FOLD} + (rep2 - 1) * {N_FOLD} + test_fold AS BIGINT) AS task_id, config_id2 AS config_id, rep2 AS rep,
    test_fold AS fold, {r6('test_auroc', 'test_auroc')}
    FROM nos, more, fold_nos LEFT JOIN results r ON r.config_id = config_id2 AND r.rep = rep2 AND r.fold = test_fold""",
)
def _(spark, folder):
    # One replication more than was run: its tasks keep NULL.
    from lociq.sources.fixtures import given_scores

    configs = given_scores(cases(spark, folder)).select("config_id").distinct()
    tasks = T.task_table(configs, N_REP + 1, N_FOLD)
    done = results(spark, folder).join(tasks, ["config_id", "rep", "fold"]).select("task_id", "test_auroc")
    return rounded(T.write_back(tasks, done).select("task_id", "config_id", "rep", "fold", "test_auroc"))
