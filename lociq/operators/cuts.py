"""Exact quantiles of many features, and bins between them.

Doubles are turned into 64-bit numbers in the same order. A pass counts values by
feature and leading digits; running totals say which cell holds a wanted rank, and
the next pass looks at 16 bits more inside these cells only. A cell whose least and greatest
value are one value needs no further pass, so few passes read all bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits told apart by a pass.
DIGIT = 16
_ALL = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _ALL)


def number(code: int) -> float:
    """The double of an ordered number."""
    bits = np.int64(code)
    return float((bits ^ ((bits >> 63) & _ALL)).view(np.float64))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column with ``width`` numbers each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _count(batches: Iterator[pa.RecordBatch], width: int, shift: int, wanted: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """(feature, cell, n, low, high): values by their bits above ``shift``, in the wanted cells of the pass before."""
    for batch in batches:
        x = matrix(batch.column(0), width)
        parts = []
        for f in range(width):
            codes = np.sort(ordered(x[~np.isnan(x[:, f]), f]))
            if wanted is not None:
                codes = codes[np.isin(codes >> (shift + DIGIT), wanted.value[f])]
            cell = codes >> shift
            edge = np.flatnonzero(np.diff(cell)) + 1
            first, last = np.append(0, edge)[: len(cell)], np.append(edge, len(cell))[: len(cell)] - 1
            parts.append((np.full(len(first), f), cell[first], last - first + 1, codes[first], codes[last]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names=["feature", "cell", "n", "low", "high"])


def exact_quantiles(rows: DataFrame, width: int, parts: int, features: str = "features") -> list[list[float | None]]:
    """For each feature the values at rank ceil(i n / parts), i = 1 to parts - 1, of its n values; None for a feature without values.

    NULL and NaN are no values. Results are width x (parts - 1) numbers, whatever the rows.
    """
    spark = rows.sparkSession
    empty = F.array_repeat(F.lit(None).cast("double"), width)
    table = rows.select(F.coalesce(F.col(features).cast("array<double>"), empty).alias("x"))
    found: list[list[float | None]] = [[None] * (parts - 1) for _ in range(width)]
    asked, wanted = None, None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        counted = table.mapInArrow(lambda b, s=shift, w=wanted: _count(b, width, s, w), "feature long, cell long, n long, low long, high long")
        cells = counted.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        cells = cells.withColumn("above", F.shiftright("cell", DIGIT) if asked is not None else F.lit(0).cast("long"))
        cells = cells.selectExpr("*", "sum(n) OVER (PARTITION BY feature, above ORDER BY cell) - n AS before", "sum(n) OVER (PARTITION BY feature, above) AS total")
        if asked is None:
            cells = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(parts - 1))).alias("i")).withColumn("rank", F.expr(f"(i * total + {parts - 1}) div {parts}"))
        else:
            cells = cells.join(F.broadcast(asked), ["feature", "above"])
        hits = cells.where("before < rank AND rank <= before + n").select("feature", "i", "cell", (F.col("rank") - F.col("before")).alias("rank"), "low", "high").collect()
        for hit in hits:
            if hit["low"] == hit["high"]:
                found[hit["feature"]][hit["i"] - 1] = number(hit["low"])
        left = [h for h in hits if h["low"] != h["high"]]
        if not left:
            break
        asked = spark.createDataFrame([(h["feature"], h["cell"], h["i"], h["rank"]) for h in left], "feature long, above long, i int, rank long")
        wanted = spark.sparkContext.broadcast([np.array(sorted({h["cell"] for h in left if h["feature"] == f}), np.int64) for f in range(width)])
    return found


def quantile_cuts(cases: DataFrame, n_features: int, n_bins: int = 32, features: str = "features") -> list[list[float]]:
    """Cut points of each feature: its distinct exact quantiles. They do not depend on partitions."""
    return [sorted({c for c in row if c is not None}) for row in exact_quantiles(cases, n_features, n_bins, features)]


def binned(cases: DataFrame, cuts: Sequence[Sequence[float]], features: str = "features") -> DataFrame:
    """Replace features by bin numbers: the count of cuts below the value, -1 when missing."""
    edges = F.array(*[F.array(*[F.lit(float(c)) for c in row]).cast("array<double>") for row in cuts])
    bins = F.transform(
        F.arrays_zip(F.col(features).alias("x"), edges.alias("e")),
        lambda z: F.when(z["x"].isNull() | F.isnan(z["x"]), F.lit(-1)).otherwise(F.size(F.filter(z["e"], lambda c: c < z["x"]))).cast("smallint"),
    )
    return cases.withColumn("bins", bins).drop(features)
