"""Scorers trained with Spark ML, one fit per task: for few, large tasks.

Many small tasks go through ``boost``, where tasks are rows.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _split(members: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
    if members.schema[features].dataType.typeName() == "array":
        members = members.withColumn(features, array_to_vector(features))
    return members.where("role = 'train'"), members


# Fixed value: the largest depth of a tree in Spark ML.
DEEPEST = 30


def _weighted(train: DataFrame, weight: float) -> DataFrame:
    return train.withColumn("_weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def boosted_scores(members: DataFrame, hp: Mapping[str, float], seed: int = 1337, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Gradient-boosted trees: (members with ``score`` and ``run_time``, feature importance).

    eta, nrounds, max_depth, subsample and scale_pos_weight carry over; gamma,
    lambda, alpha and base_score have no counterpart here and need ``boost``.
    """
    unknown = set(hp) - {"eta", "nrounds", "max_depth", "subsample", "scale_pos_weight"}
    if unknown:
        raise ValueError(f"not available in this trainer: {sorted(unknown)}")
    train, everyone = _split(members, features)
    learner = GBTClassifier(
        featuresCol=features, labelCol="label", weightCol="_weight", seed=seed,
        stepSize=float(hp.get("eta", 0.1)), maxIter=int(hp.get("nrounds", 20)),
        maxDepth=int(hp.get("max_depth", 5)), subsamplingRate=float(hp.get("subsample", 1.0)),
    )
    started = time.time()
    model = learner.fit(_weighted(train, hp.get("scale_pos_weight", 1.0)))
    took = time.time() - started
    scored = model.transform(everyone).withColumn("score", vector_to_array("probability")[1])
    return _tidy(scored, took), importance(model, members)


def forest_scores(
    members: DataFrame, hp: Mapping[str, float], seed: int = 1337, features: str = "features", votes: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Random forest: (members with ``score`` and ``run_time``, feature importance).

    The score is the mean class-1 probability of the trees, or with ``votes``
    the fraction of trees that vote 1. ``weight_positive_class`` weighs
    positives in the impurity. Without ``max_depth`` trees grow as deep as Spark ML lets them.
    """
    train, everyone = _split(members, features)
    learner = RandomForestClassifier(
        featuresCol=features, labelCol="label", weightCol="_weight", seed=seed,
        numTrees=int(hp.get("num_trees", 100)), maxDepth=int(hp.get("max_depth", DEEPEST)),
        featureSubsetStrategy=str(int(hp["mtry"])) if "mtry" in hp else "sqrt",
        subsamplingRate=float(hp.get("sample_fraction", 1.0)), bootstrap=bool(hp.get("replace", True)),
    )
    started = time.time()
    model = learner.fit(_weighted(train, hp.get("weight_positive_class", 1.0)))
    took = time.time() - started
    if votes:
        scored, names = everyone, []
        for i, tree in enumerate(model.trees):
            names.append(f"_vote{i}")
            tree = tree.copy().setFeaturesCol(features).setPredictionCol(names[-1]).setRawPredictionCol("").setProbabilityCol("")
            scored = tree.transform(scored)
        scored = scored.withColumn("score", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)
    else:
        scored = model.transform(everyone).withColumn("score", vector_to_array("probability")[1])
    return _tidy(scored, took), importance(model, members)


def _tidy(scored: DataFrame, seconds: float) -> DataFrame:
    extra = [c for c in ("rawPrediction", "probability", "prediction", "_weight") if c in scored.columns]
    return scored.drop(*extra).withColumn("run_time", F.lit(seconds))


def importance(model, like: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted model, summing to one; as many rows as features."""
    values = model.featureImportances.toArray()
    return like.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "feature int, importance double")


def collect_importance(parts: Mapping[tuple[int, int, int], DataFrame]) -> DataFrame:
    """Importance tables of several tasks as one: (config_id, rep, fold, feature, importance)."""
    out = None
    for (config, rep, fold), df in parts.items():
        one = df.select(F.lit(config).alias("config_id"), F.lit(rep).alias("rep"), F.lit(fold).alias("fold"), "feature", "importance")
        out = one if out is None else out.unionByName(one)
    return out
