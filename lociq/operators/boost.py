"""Gradient boosting with second-order statistics, all tasks growing together.

A case is one row: its bins are written once for a block of tasks, and beside them is an array of
predictions, rewritten once a tree. What is written grows with cases x (features + tasks), not
with their product. Gains and leaf weights follow Chen and Guestrin (2016); splits are
sought at bin edges.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.draws import hash_bits_py, uniform
from lociq.operators.cuts import binned, quantile_cuts  # noqa: F401 - what training begins with
from lociq.operators.objective import rank_objective
from lociq.operators.trees import TEST, TRAIN, Plan, Tree, add_leaves, grow
from lociq.session import discard, use_checkpoint_folder

# Settings of a task that does not state them.
DEFAULTS = {
    "eta": 0.3,
    "nrounds": 10.0,
    "gamma": 0.0,
    "lambda": 1.0,
    "alpha": 0.0,
    "subsample": 1.0,
    "colsample_bytree": 1.0,
    "base_score": 0.5,
    "scale_pos_weight": 1.0,
    "max_depth": 6.0,
    "min_child_weight": 1.0,
}
_SETTING = {name: "l2" if name == "lambda" else name for name in DEFAULTS}
#: Tasks that grow together, and histogram cells of the deepest level they may have.
BLOCK_TASKS, BLOCK_CELLS = 256, 1 << 26

Objective = Callable[[DataFrame], DataFrame]


@dataclass
class Boosted:
    """Scores of every (task, case), the splits with their statistics, and the leaves."""

    scores: DataFrame
    splits: DataFrame
    leaves: DataFrame


def task_settings(tasks: DataFrame, hp: str = "hp") -> DataFrame:
    """(task_id, one column per setting) from the parameter map of each task; ``bandwidth`` is NULL where it is not stated."""
    stated = [F.coalesce(F.col(hp)[name], F.lit(value)).cast("double").alias(_SETTING[name]) for name, value in DEFAULTS.items()]
    return tasks.select("task_id", *stated, F.col(hp)["bandwidth"].cast("double").alias("bandwidth"))


@dataclass
class Logistic:
    """Gradients of the logistic loss for the task at a place; positives weigh what the task says."""

    positive: list[float]

    def __call__(self, at: int, pred: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-pred)), np.where(label == 1, self.positive[at], 1.0)
        return w * (p - label), w * p * (1 - p)


def rank_by_bandwidth(train: DataFrame) -> DataFrame:
    """The within-locus rank objective over the training rows of each task, with the task's own bandwidth."""
    return rank_objective(train, ["task_id"], "bandwidth")


def newton_boost(
    cases: DataFrame,
    members: DataFrame,
    settings: DataFrame,
    cuts: Sequence[Sequence[float]],
    seed: int = 1337,
    objective: Objective | None = None,
    key: Sequence[str] = ("case_id",),
    block_tasks: int = BLOCK_TASKS,
) -> Boosted:
    """Train every task on its ``train`` members and score all its members.

    ``cases`` has a row for each ``key`` with label, bins and what the objective needs; ``members`` has
    task_id, the key and role; ``settings`` comes from ``task_settings``. The
    objective is logistic; tasks with a bandwidth, or all where an ``objective`` is given, get theirs from a
    DataFrame of their training rows (task_id, key, label, pred, settings, further columns) to which it adds grad and hess.
    The table of tasks is a parameter table and is read by the driver; cases never are. Memory of the
    driver and of what is sent holds the trees of one round of ``block_tasks`` tasks.
    """
    spark = cases.sparkSession
    folder = f"{use_checkpoint_folder(spark).rstrip('/')}/boost-{uuid.uuid4()}"
    tasks = settings.orderBy("task_id").toArrow().to_pylist()
    n_bins = max((len(c) for c in cuts), default=0) + 2
    deepest = max((int(t["max_depth"]) for t in tasks), default=1)
    size = max(1, min(block_tasks, BLOCK_CELLS // (2 ** min(deepest, 40) * max(1, len(cuts)) * n_bins)))
    for k, first in enumerate(range(0, len(tasks), size)):
        _block(cases, members, tasks[first : first + size], cuts, n_bins, seed, objective, list(key), f"{folder}/{k}", folder)
    extra = [c for c in cases.columns if c not in (*key, "bins")]
    kinds = dict(settings.dtypes)
    none = lambda schema: spark.createDataFrame([], f"task_id {kinds['task_id']}, {schema}")
    if not tasks:
        scores = members.join(cases.select(*key, *extra), list(key)).withColumn("margin", F.lit(0.0)).withColumn("score", F.lit(0.5)).limit(0)
        return Boosted(scores, none(_SPLITS), none(_LEAVES))
    scores = spark.read.parquet(f"{folder}/scores").select("task_id", *key, "role", *extra, "margin", "score")
    return Boosted(scores, spark.read.parquet(f"{folder}/splits"), spark.read.parquet(f"{folder}/leaves"))


_SPLITS = "tree int, node long, feature long, bin long, missing_left boolean, gain double, cover double"
_LEAVES = "tree int, node long, weight double, cover double"


def _block(cases: DataFrame, members: DataFrame, tasks: list[dict], cuts: Sequence, n_bins: int, seed: int, objective: Objective | None, key: list[str], folder: str, results: str) -> None:
    """Train one block of tasks and append its scores, splits and leaves."""
    spark = cases.sparkSession
    kind = dict(members.dtypes)["task_id"]
    table = spark.createDataFrame([(k, *t.values()) for k, t in enumerate(tasks)], f"at int, task_id {kind}, " + ", ".join(f"{c} double" for c in list(tasks[0])[1:]))
    table = F.broadcast(table)
    told = frozenset(k for k, t in enumerate(tasks) if objective is not None or t["bandwidth"] is not None)
    sampled = [k for k, t in enumerate(tasks) if t["subsample"] < 1]

    # Roles of a case as one array; a task it is no member of has 0.
    role = F.when(F.col("role") == "train", TRAIN).otherwise(TEST)
    mine = members.join(table.select("task_id", "at"), "task_id").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("at", role.alias("r")))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(len(tasks) - 1))
    roles = F.transform(places, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)).cast("tinyint"))
    start = F.array(*[F.lit(math.log(t["base_score"] / (1 - t["base_score"]))) for t in tasks])
    state = cases.join(mine, key).withColumn("roles", roles).withColumn("preds", start).drop("_m")
    state = _written(state, f"{folder}/0")

    n_rounds = max(int(t["nrounds"]) for t in tasks)
    gradients = Logistic([t["scale_pos_weight"] for t in tasks])
    splits, leaves = [], []
    for tree in range(1, n_rounds + 1):
        active = [k for k, t in enumerate(tasks) if t["nrounds"] >= tree]
        rows = state
        drawn = [k for k in sampled if k in active]
        if drawn:
            share = F.array(*[F.struct(F.lit(tasks[k]["task_id"]).alias("t"), F.lit(tasks[k]["subsample"]).alias("s")) for k in drawn])
            names = [F.col(c) for c in key]
            rows = rows.withColumn("weights", F.transform(share, lambda z: (uniform(seed, z["t"], F.lit(tree), *names) < z["s"]).cast("double")))
        asked = told.intersection(active)
        if asked:
            each = rows.select(*[c for c in state.columns if c not in ("bins", "roles", "preds")], F.posexplode(F.arrays_zip("preds", "roles")).alias("at", "_z"))
            each = each.where((F.col("_z")["roles"] == TRAIN) & F.col("at").isin(sorted(asked))).withColumn("pred", F.col("_z")["preds"]).drop("_z")
            given = (objective or rank_by_bandwidth)(each.join(table, "at"))
            given = given.groupBy(*key).agg(F.collect_list(F.struct("at", "grad", "hess")).alias("told"))
            rows = rows.join(given, key, "left")
        if asked or drawn:
            rows = _written(rows, f"{folder}/rows-{tree}")  # every level reads it
        trees = {k: Tree() for k in active}
        plan = Plan(len(cuts), n_bins, trees, {k: kept_features(tasks[k], len(cuts), seed, tree) for k in active}, drawn, asked, gradients, True)
        found = grow(rows, plan, table, {k: int(tasks[k]["max_depth"]) for k in active})
        splits += [(tasks[s["at"]]["task_id"], tree, s["node"], s["feature"], s["bin"], s["missing_left"], s["gain"], s["cover"]) for s in found]
        weights = {k: (t, leaf_weights(t, tasks[k])) for k, t in trees.items()}
        leaves += [(tasks[k]["task_id"], tree, t.heap[i], float(w[i]), t.h[i]) for k, (t, w) in weights.items() for i in range(len(t.heap)) if not t.left[i]]
        sent = spark.sparkContext.broadcast(weights)
        width = len(cuts)
        moved = state.mapInArrow(lambda b, s=sent: add_leaves(b, width, s), state.schema)
        state = _written(moved, f"{folder}/{tree}")
        sent.destroy()
        discard(spark, f"{folder}/{tree - 1}")
        if asked or drawn:
            discard(spark, f"{folder}/rows-{tree}")

    extra = [c for c in state.columns if c not in ("bins", "roles", "preds")]
    scored = state.select(*extra, F.posexplode(F.arrays_zip("preds", "roles")).alias("at", "_z")).where(F.col("_z")["roles"] > 0)
    scored = scored.join(table.select("at", "task_id"), "at").withColumn("margin", F.col("_z")["preds"]).withColumn("score", 1.0 / (1.0 + F.exp(-F.col("margin"))))
    scored = scored.withColumn("role", F.when(F.col("_z")["roles"] == TRAIN, "train").otherwise("test")).drop("_z", "at")
    scored.write.mode("append").parquet(f"{results}/scores")
    discard(spark, f"{folder}/{n_rounds}")
    spark.createDataFrame(splits, f"task_id {kind}, {_SPLITS}").coalesce(1).write.mode("append").parquet(f"{results}/splits")
    spark.createDataFrame(leaves, f"task_id {kind}, {_LEAVES}").coalesce(1).write.mode("append").parquet(f"{results}/leaves")


def _written(df: DataFrame, path: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def leaf_weights(tree: Tree, task: dict) -> np.ndarray:
    """The step of each node from the sums of its training rows."""
    g, h = np.array(tree.g), np.array(tree.h) + task["l2"]
    return np.where(h > 0, -task["eta"] * np.sign(g) * np.maximum(np.abs(g) - task["alpha"], 0) / np.where(h > 0, h, 1), 0.0)


def kept_features(task: dict, n_features: int, seed: int, tree: int) -> list[int]:
    """Features a task may use in a tree: a random share of them, at least one."""
    count = max(1, int(task["colsample_bytree"] * n_features + 0.5))
    if count >= n_features:
        return list(range(n_features))
    drawn = sorted((hash_bits_py(seed, "feature", task["task_id"], tree, f), f) for f in range(n_features))
    return sorted(f for _, f in drawn[:count])


def split_importance(splits: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Share of gain, cover and number of splits per feature."""
    sums = splits.groupBy(*keys, "feature").agg(F.sum("gain").alias("gain"), F.sum("cover").alias("cover"), F.count(F.lit(1)).alias("n"))
    totals = splits.groupBy(*keys).agg(F.sum("gain").alias("_g"), F.sum("cover").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return sums.join(totals, list(keys)).select(
        *keys,
        "feature",
        (F.col("gain") / F.col("_g")).alias("gain"),
        (F.col("cover") / F.col("_c")).alias("cover"),
        (F.col("n") / F.col("_n")).alias("frequency"),
    )
