"""Hyperparameter grids, configurations and the task table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.functions.draws import hash_bits


def grid(base: DataFrame, values: Mapping[str, Sequence | Column], fastest: str = "last") -> DataFrame:
    """All combinations of the listed values for every row of ``base``.

    A value list is a Python sequence or an array column of ``base`` (so a list
    may come from data). Adds one column per parameter and ``hp_no`` from 1;
    ``fastest`` says whether the ``last`` or the ``first`` parameter varies fastest.
    """
    if fastest not in ("first", "last"):
        raise ValueError("fastest must be first or last")
    out, number, stride = base, F.lit(1).cast("bigint"), F.lit(1).cast("bigint")
    lists = {name: v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v]) for name, v in values.items()}
    for name, array in lists.items():
        out = out.withColumn(f"_{name}", array)
    for name in lists:
        out = out.select("*", F.posexplode(f"_{name}").alias(f"_at_{name}", name))
    for name in reversed(lists) if fastest == "last" else lists:
        number = number + F.col(f"_at_{name}") * stride
        stride = stride * F.size(f"_{name}")
    return out.withColumn("hp_no", number).drop(*[f"_{n}" for n in lists], *[f"_at_{n}" for n in lists])


def hp_map(df: DataFrame, names: Sequence[str], out: str = "hp") -> DataFrame:
    """Gather parameter columns into one MAP<STRING, DOUBLE> column."""
    entries = [part for n in names for part in (F.lit(n), F.col(n).cast("double"))]
    return df.withColumn(out, F.create_map(*entries)).drop(*names)


def hyperparameter_grid(base: DataFrame, values: Mapping[str, Sequence | Column], fastest: str = "last") -> DataFrame:
    """Grid with the parameters of each point in a map column ``hp``."""
    return hp_map(grid(base, values, fastest), list(values))


def pair_parameters(df: DataFrame, points: Sequence[Mapping[str, float]], number: str = "hp_no", how: str = "recycle") -> DataFrame:
    """Pair numbered rows with a second, short parameter list.

    ``recycle`` gives row i the entry i mod n (the list is repeated, not
    crossed); ``product`` gives every row every entry.
    """
    names = list(points[0])
    entries = F.array(*[F.struct(*[F.lit(float(p[n])).alias(n) for n in names]) for p in points])
    if how == "recycle":
        picked = df.withColumn("_p", F.element_at(entries, (F.pmod(F.col(number) - 1, F.lit(len(points))) + 1).cast("int")))
    elif how == "product":
        picked = df.withColumn("_p", F.explode(entries))
    else:
        raise ValueError(f"how must be recycle or product, not {how}")
    return picked.select(*df.columns, "_p.*")


def order_configurations(configs: DataFrame, set_type: str = "set_type", set_name: str = "set_name", tie: Sequence[str] = ("hp_no",)) -> DataFrame:
    """Number configurations 1..n by (set type, set name); the list is a parameter table, not data."""
    order = Window.orderBy(set_type, set_name, *tie)
    return configs.withColumn("config_id", F.row_number().over(order))


def shuffle_configurations(configs: DataFrame, seed: int, config: str = "config_id") -> DataFrame:
    """Random but repeatable processing order of the configurations."""
    return configs.withColumn("run_order", F.row_number().over(Window.orderBy(hash_bits(seed, config), config)))


def concat_configurations(parts: Iterable[DataFrame]) -> DataFrame:
    """One list from several families; settings a family lacks stay NULL."""
    parts = list(parts)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def task_table(configs: DataFrame, n_rep: int, n_fold: int, config: str = "config_id") -> DataFrame:
    """Configurations x replications x folds, numbered from 1 in that order.

    ``config_id`` runs from 1 without gaps, so the number is arithmetic and no
    sort is needed, however many tasks there are.
    """
    return (
        configs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_rep))))
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_fold))))
        .withColumn("fold_index", (F.col("rep") - 1) * n_fold + F.col("fold"))
        .withColumn("task_id", (F.col(config).cast("bigint") - 1) * (n_rep * n_fold) + F.col("fold_index"))
    )


def unresolved_names(configs: DataFrame, column: str, registry: Mapping | Iterable[str], spark: SparkSession) -> DataFrame:
    """Names that configurations refer to but the registry lacks; empty when all resolve."""
    known = spark.createDataFrame([(n,) for n in registry], f"{column} string")
    wanted = configs.select(column).where(F.col(column).isNotNull()).distinct()
    return wanted.join(known, column, "left_anti")


def resolve(registry: Mapping, name: str):
    """The registered callable or table, or a clear error."""
    if name not in registry:
        raise KeyError(f"{name} is not registered; known: {', '.join(sorted(registry))}")
    return registry[name]


def write_back(tasks: DataFrame, results: DataFrame, task: str = "task_id") -> DataFrame:
    """Results joined to their task rows; a task without a result keeps NULL metrics."""
    extra = [c for c in results.columns if c == task or c not in tasks.columns]
    return tasks.join(results.select(*extra), task, "left")
