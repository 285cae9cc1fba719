"""Supervised feature reduction: partial least squares, all tasks at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.cuts import matrix
from lociq.operators.joins import join_small

# Groups that the partial sums of a task's rows are first added up in, and bytes of sums a Spark task holds.
GROUPS, HELD_BYTES = 256, 64 << 20


def pls_scores(members: DataFrame, n_components: int, keys: Sequence[str] = ("task_id",), features: str = "features", label: str = "label") -> DataFrame:
    """Scores of the first components for all cases, fitted on the ``train`` members of each task.

    One pass over the training rows adds up X'X, X'y and the sums of x and y of each task, in two steps so that
    no task's sums meet in one place from everywhere; components follow from these small matrices, and a
    second pass projects all members. Adds ``pls`` ARRAY<DOUBLE>.
    """
    keys = list(keys)
    train = members.where("role = 'train'").select(*keys, F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in train.dtypes[: len(keys)])
    sums = train.mapInArrow(lambda b: _sums(b, keys), f"{kinds}, part int, sums binary")
    sums = sums.groupBy(*keys, "part").applyInArrow(lambda t: _added(t, keys), f"{kinds}, sums binary")
    model = sums.groupBy(*keys).applyInArrow(lambda t: _fitted(_added(t, keys), keys, n_components), f"{kinds}, mean array<double>, rotations array<double>")
    n_columns = F.size(F.col(features))
    width = members.select(F.max(n_columns)).first()[0] or 0
    joined = join_small(members, model, keys, values_per_row=width * (n_components + 1))
    centred = F.zip_with(features, "mean", lambda x, m: x - m)
    component = lambda a: F.aggregate(
        F.zip_with(centred, F.slice("rotations", a * n_columns + 1, n_columns), lambda x, r: x * r), F.lit(0.0), lambda s, v: s + v
    )
    return joined.withColumn("pls", F.array(*[component(a) for a in range(n_components)])).drop("mean", "rotations")


def _sums(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial sums (n, y, x, x y, x x') of each key."""
    held: dict[tuple, np.ndarray] = {}
    part = TaskContext.get().partitionId() % GROUPS

    def rows() -> pa.RecordBatch:
        names = [*keys, "part", "sums"]
        columns = [pa.array([k[i] for k in held], kinds[i]) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=names)

    kinds: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(k).type for k in keys]
        x = matrix(batch.column("x"), len(batch.column("x").flatten()) // batch.num_rows)
        y = batch.column("y").to_numpy()
        for key, at in batch.select(keys).to_pandas().groupby(keys, sort=False).indices.items():
            one, v = x[at], y[at]
            new = np.concatenate([[len(at), v.sum()], one.sum(0), one.T @ v, (one.T @ one).ravel()])
            key = tuple(k.item() if hasattr(k, "item") else k for k in (key if isinstance(key, tuple) else (key,)))
            held[key] = held[key] + new if key in held else new
        if sum(v.nbytes for v in held.values()) > HELD_BYTES:
            yield rows()
            held = {}
    if held:
        yield rows()


def _added(table: pa.Table, keys: list[str]) -> pa.Table:
    """The sums of one key, added up."""
    total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("sums"))
    return table.select(keys).slice(0, 1).append_column("sums", pa.array([total.tobytes()], pa.binary()))


def _fitted(table: pa.Table, keys: list[str], n_components: int) -> pa.Table:
    """Means and rotations from the sums of one key: centred features times a rotation give a component's scores."""
    sums = np.frombuffer(table.column("sums")[0].as_buffer(), np.float64)
    size = int(round(np.sqrt(len(sums) - 1))) - 1
    n, sy, sx, xy, xx = sums[0], sums[1], sums[2 : 2 + size], sums[2 + size : 2 + 2 * size], sums[2 + 2 * size :].reshape(size, size)
    mean = sx / n
    xy, xx = xy - mean * sy, xx - n * np.outer(mean, mean)
    rotations, loadings, left = [], [], xy.copy()
    for _ in range(n_components):
        norm = np.linalg.norm(left)
        rotation = left / norm if norm else left.copy()
        for r, p in zip(rotations, loadings, strict=True):
            rotation = rotation - (p @ rotation) * r
        spread = rotation @ xx @ rotation
        loading = xx @ rotation / spread if spread > 0 else np.zeros(size)
        left = left - loading * (rotation @ xy)
        rotations.append(rotation)
        loadings.append(loading)
    return table.select(keys).append_column("mean", pa.array([mean])).append_column("rotations", pa.array([np.concatenate(rotations)]))
