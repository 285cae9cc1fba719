"""Configuration lists of the published comparisons, as parameter tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.operators.tasks import concat_configurations, hyperparameter_grid, order_configurations, pair_parameters

# The tuning grid of the boosted trees (4608 points) and the bandwidths of the rank objective.
TUNING_GRID = {
    "eta": [0.05, 0.1, 0.15, 0.2],
    "nrounds": [10, 20, 30, 40],
    "gamma": [5, 10, 100, 200],
    "lambda": [0.1, 1.0, 5.0, 10.0],
    "subsample": [0.75, 0.85, 1],
    "scale_pos_weight": [1.0, 14.45],
    "max_depth": [5, 6, 7],
}
OBJECTIVE_GRID = {
    "eta": [0.05, 0.1, 0.15, 0.2],
    "nrounds": [20, 30, 40],
    "gamma": [5, 10, 30, 100],
    "lambda": [0.1, 1.0, 5.0, 10.0],
    "subsample": [0.85, 1],
    "scale_pos_weight": [1.0, 14.45],
    "max_depth": [6, 7, 8],
}
BANDWIDTHS = [{"bandwidth": 0.1}, {"bandwidth": 0.5}, {"bandwidth": 1.0}]

# Best parameters of the boosted trees and of the published forests.
BEST_AVGRANK = {"eta": 0.1, "nrounds": 30, "gamma": 100, "subsample": 0.85, "colsample_bytree": 0.85, "scale_pos_weight": 8, "max_depth": 6}
BEST_AUPVR = {"eta": 0.1, "nrounds": 30, "gamma": 10, "subsample": 1, "colsample_bytree": 0.85, "scale_pos_weight": 1, "max_depth": 6}
DEEP = {"eta": 0.1, "nrounds": 10, "alpha": 20, "lambda": 2000, "scale_pos_weight": 8}
FOREST_47 = {"mtry": 47, "num_trees": 100, "weight_positive_class": 8, "replace": 1, "sample_fraction": 1}
FOREST_14 = {"mtry": 14, "num_trees": 100, "weight_positive_class": 1, "replace": 1, "sample_fraction": 1}
BEST_NEWER = {"eta": 0.1, "nrounds": 40, "gamma": 10, "lambda": 1, "subsample": 1, "scale_pos_weight": 1, "max_depth": 7}
BEST_OTHER = {"eta": 0.15, "nrounds": 40, "gamma": 5, "lambda": 10, "subsample": 1, "scale_pos_weight": 1, "max_depth": 7}


def _family(set_type: str, set_name: str, matrix: str | None, method: str, *points: dict) -> dict:
    return {"set_type": set_type, "set_name": set_name, "matrix": matrix, "method": method, "points": list(points)}


# The fourteen compared configurations, by family.
COMPARISON = [
    _family("XGB", "main_XGB", "feat_main_sparsematrix", "XGB", BEST_AVGRANK, BEST_AUPVR),
    _family("XGBDS", "Deepsea_XGB_published", "feat_deepsea_matrix", "XGB", DEEP),
    _family("XGBdanq", "DANQ_XGB", "feat_DANQ", "XGB", DEEP),
    _family("XGB", "RSVP_XGB", "feat_RSVP_matrix", "XGB", BEST_AVGRANK, BEST_AUPVR),
    _family("XGB", "deltaSVM_XGB", "feat_deltaSVM_matrix", "XGB", BEST_AVGRANK, BEST_AUPVR),
    _family("ranger", "GWAVA_RF_published", "feat_GWAVA_ranger", "ranger", FOREST_14),
    _family("ranger", "RSVP_RF_published", "feat_RSVP_ranger", "ranger", FOREST_47),
    _family("passthrough", "CADD", None, "CADD"),
    _family("passthrough", "fitCons", None, "fitCons"),
    _family("passthrough", "eigen", None, "eigen"),
    _family("passthrough", "DANN", None, "DANN"),
]
# The three configurations of the comparison on the newer table.
COMPARISON_NEWER = [
    _family("XGB", "main_XGB", "feat_main_sparsematrix", "XGB", BEST_NEWER),
    _family("XGB", "GWAVA_XGB", "feat_GWAVA_sparsematrix", "XGB", BEST_OTHER),
    _family("ranger", "GWAVA_RF_published", "feat_GWAVA_df", "ranger", FOREST_14),
]


def tuning_grid(balance: DataFrame, values: dict[str, list] = TUNING_GRID) -> DataFrame:
    """Grid points (hp_no, hp); the starting score is the fraction of positives of the data."""
    lists: dict[str, list | Column] = {**values, "base_score": F.array("fraction_positive")}
    return hyperparameter_grid(balance, lists).select("hp_no", "hp")


def objective_grid(balance: DataFrame, values: dict[str, list] = OBJECTIVE_GRID, bandwidths: list[dict] = BANDWIDTHS, how: str = "recycle") -> DataFrame:
    """Tuning with the default objective, then the same points with the rank objective and a recycled (or crossed) bandwidth.

    Numbered configurations (config_id, set_type, set_name, method, hp_no, hp); the bandwidth is a parameter like the others.
    """
    points = tuning_grid(balance, values)
    plain = points.withColumn("set_name", F.lit("main_XGB"))
    paired = pair_parameters(points, bandwidths, how=how)
    if how == "product":
        paired = paired.withColumn("hp_no", (F.col("hp_no") - 1) * len(bandwidths) + F.array_position(F.array(*[F.lit(float(b["bandwidth"])) for b in bandwidths]), F.col("bandwidth")))
    ranked = paired.select("hp_no", F.map_concat("hp", F.create_map(F.lit("bandwidth"), F.col("bandwidth"))).alias("hp"), F.lit("main_XGB_custom").alias("set_name"))
    both = concat_configurations([plain, ranked]).withColumn("set_type", F.lit("XGB")).withColumn("method", F.lit("XGB"))
    return order_configurations(both)


def comparison(balance: DataFrame, families: list[dict] = COMPARISON) -> DataFrame:
    """Numbered configurations (config_id, set_type, set_name, matrix, method, hp_no, hp)."""
    return order_configurations(concat_configurations([_configs(balance, f) for f in families]))


def _configs(balance: DataFrame, family: dict) -> DataFrame:
    """The configurations of one family; trees that do not fix it start from the fraction of positives."""
    head = [F.lit(family[c]).cast("string").alias(c) for c in ("set_type", "set_name", "matrix", "method")]
    points = [_hp(p, family) for p in family["points"]] or [F.lit(None).cast("map<string,double>")]
    return balance.select(*head, F.posexplode(F.array(*points)).alias("_i", "hp")).withColumn("hp_no", (F.col("_i") + 1).cast("bigint")).drop("_i")


def _hp(point: dict, family: dict) -> Column:
    entries = [F.create_map(F.lit(k), F.lit(float(v))) for k, v in point.items()]
    if family["set_type"] == "XGB":
        entries.append(F.create_map(F.lit("base_score"), F.col("fraction_positive")))
    return reduce(lambda a, b: F.map_concat(a, b), entries)
