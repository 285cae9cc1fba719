"""Trees of many tasks that grow together over rows that hold each case once.

A row has a case's bins and, beside them, arrays with one entry for each task of a block: its role in
the task, its prediction, its weight in the sample. A level of all trees is one pass that adds
gradients by (task, node, feature, bin) and one small table of best splits. Only
the lighter child of a split is counted; the other is its parent minus that. Nodes are numbered
like a heap: children of k are 2k and 2k + 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.operators.cuts import matrix
from lociq.session import cut_lineage

#: Bytes of rows whose histograms a task adds up before it hands them on.
CHUNK_BYTES = 32 << 20
TRAIN, TEST = 1, 2
_CELL_NAMES = ("at", "node", "feature", "bin", "g", "h", "n")
_CELLS = "at long, node long, feature long, bin long, g double, h double, n long"


@dataclass
class Tree:
    """Nodes in order of making: split (feature, bin, side of missing values), left child (0: none, right is the next), heap number, sums, and whether to count."""

    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [0])
    heap: list = field(default_factory=lambda: [1])
    g: list = field(default_factory=lambda: [0.0])
    h: list = field(default_factory=lambda: [0.0])
    counted: list = field(default_factory=lambda: [True])
    depth: int = 0

    def split(self, node: int, row: dict, grows: bool) -> None:
        """Give the node with a heap number its children; the lighter one is counted next if the tree grows on."""
        k = self.heap.index(node)
        self.feature[k], self.bin[k], self.missing_left[k], self.left[k] = row["feature"], row["bin"], row["missing_left"], len(self.heap)
        lighter = row["hl"] <= row["ht"] - row["hl"]
        for side, g, h in ((0, row["gl"], row["hl"]), (1, row["gt"] - row["gl"], row["ht"] - row["hl"])):
            for name, value in zip(("feature", "bin", "missing_left", "left", "heap", "g", "h"), (0, 0, False, 0, 2 * node + side, g, h), strict=True):
                getattr(self, name).append(value)
            self.counted.append(grows and lighter == (side == 0))
        self.depth = node.bit_length()

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The place of the leaf of each row of bins."""
        feature, cut, missing_left, left = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            value = bins[rows, feature[node]]
            right = np.where(value < 0, ~missing_left[node], value > cut[node])
            node = np.where(left[node] > 0, left[node] + right, node)
        return node


@dataclass
class Plan:
    """What a pass must know: the trees by place of their task, the features each may use, and how gradients come about."""

    width: int
    n_bins: int
    trees: dict[int, Tree]
    kept: dict[int, Sequence[int]]
    sampled: Sequence[int]
    told: frozenset[int]
    gradients: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    total: bool


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def count_cells(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Sums of gradients and Hessians, and rows, by (task, counted node, feature, bin); feature -1 is the whole node."""
    plan: Plan = sent.value
    place = {at: k for k, at in enumerate(plan.sampled)}
    for rows in _chunks(batches):
        if not rows.num_rows:
            continue
        n = rows.num_rows
        bins = matrix(_column(rows, "bins"), plan.width).astype(np.int64)
        roles, label = _column(rows, "roles"), _column(rows, "label").to_numpy().astype(float)
        n_tasks = len(roles.flatten()) // n
        roles, preds = matrix(roles, n_tasks), matrix(_column(rows, "preds"), n_tasks)
        weights = matrix(_column(rows, "weights"), len(place)) if place else None
        grads = _told(_column(rows, "told"), n, n_tasks) if plan.told else None
        for at, tree in plan.trees.items():
            pick = np.flatnonzero((roles[:, at] == TRAIN) & (weights[:, place[at]] > 0 if at in place else True))
            node = tree.leaf_of(bins[pick])
            counted = np.array(tree.counted)[node]
            pick, node = pick[counted], node[counted]
            if not len(pick):
                continue
            g, h = (grads[k][pick, at] for k in (0, 1)) if at in plan.told else plan.gradients(at, preds[pick, at], label[pick])
            if at in place:
                g, h = g * weights[pick, place[at]], h * weights[pick, place[at]]
            nodes, code = np.unique(node, return_inverse=True)
            heap = np.array(tree.heap)[nodes]
            found = []
            for f in [*([-1] if plan.total else []), *plan.kept[at]]:
                cell = code * plan.n_bins + (bins[pick, f] + 1 if f >= 0 else 0)
                many = np.bincount(cell)
                hit = np.flatnonzero(many)
                found.append((heap[hit // plan.n_bins], np.full(len(hit), f), hit % plan.n_bins - 1, np.bincount(cell, g)[hit], np.bincount(cell, h)[hit], many[hit]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), at)), *(pa.array(c) for c in columns)], names=_CELL_NAMES)


def _told(column: pa.Array, n: int, n_tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians, told as lists of (at, grad, hess), as matrices."""
    out = np.zeros((2, n, n_tasks))
    row = np.repeat(np.arange(n), np.asarray(column.value_lengths().fill_null(0)))
    told = column.flatten()
    at = told.field("at").to_numpy()
    out[0, row, at], out[1, row, at] = told.field("grad").to_numpy(), told.field("hess").to_numpy()
    return out[0], out[1]


def add_leaves(batches: Iterator[pa.RecordBatch], width: int, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows with the weights of their leaves added to the predictions."""
    trees = sent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("preds")
        bins, preds = matrix(batch.column("bins"), width), matrix(column, len(column.flatten()) // batch.num_rows).copy()
        for at, (tree, weight) in trees.items():
            preds[:, at] += weight[tree.leaf_of(bins)]
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * preds.shape[1]
        yield batch.set_column(batch.schema.get_field_index("preds"), "preds", pa.ListArray.from_arrays(ends, preds.ravel()))


def best_splits(cells: DataFrame, settings: DataFrame, key: str = "task_id") -> DataFrame:
    """The best split of every (task, node) that gains more than gamma, with the sums of its left side (gl, hl) and of all (gt, ht).

    Both directions of missing values are tried. Gains that agree in nine decimals are a tie, which goes to the lower
    feature, then the lower bin, then missing values on the left. ``settings`` (l2, alpha, gamma, min_child_weight) has a row for each task.
    """
    part = f"OVER (PARTITION BY {key}, node, feature"
    sums = cells.selectExpr(
        "*",
        f"sum(g) {part}) AS gt",
        f"sum(h) {part}) AS ht",
        f"sum(g) {part} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS gl",
        f"sum(h) {part} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS hl",
        f"coalesce(sum(CASE WHEN bin = -1 THEN g END) {part}), 0D) AS gm",
        f"coalesce(sum(CASE WHEN bin = -1 THEN h END) {part}), 0D) AS hm",
    )
    sides = "explode(array(named_struct('missing_left', true, 'a', gl, 'b', hl), named_struct('missing_left', false, 'a', gl - gm, 'b', hl - hm)))"
    tried = sums.selectExpr(key, "node", "feature", "bin", "gt", "ht", f"{sides} AS s").selectExpr(
        key, "node", "feature", "bin", "gt", "ht", "s.missing_left", "s.a AS gl", "s.b AS hl", "gt - s.a AS gr", "ht - s.b AS hr"
    )

    def term(g: str, h: str) -> str:
        return f"pow(greatest(abs({g}) - alpha, 0D), 2) / ({h} + l2)"

    gained = (
        tried.join(F.broadcast(settings.select(key, "l2", "alpha", "gamma", "min_child_weight")), key)
        .where("hl >= min_child_weight AND hr >= min_child_weight AND hl + l2 > 0 AND hr + l2 > 0")
        .withColumn("gain", F.expr(f"({term('gl', 'hl')} + {term('gr', 'hr')} - {term('gt', 'ht')}) / 2D - gamma"))
        .where("round(gain, 9) > 0")
    )
    order = F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin"), F.col("missing_left"))
    best = gained.groupBy(key, "node").agg(F.max_by(F.struct("feature", "bin", "missing_left", "gain", F.col("ht").alias("cover"), "gl", "hl", "gt", "ht"), order).alias("s"))
    return best.select(key, "node", "s.*")


def grow(rows: DataFrame, plan: Plan, settings: DataFrame, max_depth: dict[int, int]) -> list[dict]:
    """Grow the trees of a plan over written rows; returns the splits, at most 2^depth for each task.

    ``settings`` has ``at`` and what ``best_splits`` needs. Cells of a level are checkpointed: they are
    tasks x nodes x features x bins at most and do not grow with the rows.
    """
    spark = rows.sparkSession
    read = ["bins", "roles", "preds", "label", *(["weights"] if plan.sampled else []), *(["told"] if plan.told else [])]
    by = ["at", "node", "feature", "bin"]
    sums = [F.sum(c).alias(c) for c in ("g", "h", "n")]
    previous, parents, out = None, [], []
    for level in range(1, max(max_depth.values(), default=0) + 1):
        plan.total = level == 1
        sent = spark.sparkContext.broadcast(plan)
        cells = rows.select(*read).mapInArrow(lambda b, s=sent: count_cells(b, s), _CELLS).groupBy(*by).agg(*sums)
        if previous is not None:
            both = cells.selectExpr("at", "feature", "bin", "inline(array(named_struct('node', node, 'g', g, 'h', h, 'n', n), named_struct('node', node ^ 1L, 'g', -g, 'h', -h, 'n', -n)))")
            split = spark.createDataFrame(parents, "at long, node long, heavier long")
            whole = previous.join(F.broadcast(split), ["at", "node"]).select("at", F.col("heavier").alias("node"), "feature", "bin", "g", "h", "n")
            cells = both.select(*by, "g", "h", "n").unionByName(whole).groupBy(*by).agg(*sums).where("n > 0")
        cells = cut_lineage(cells)
        found = best_splits(cells.where("feature >= 0"), settings, "at").withColumn("tree_total", F.lit(False))
        if level == 1:
            none = {c: F.lit(None) for c in ("bin", "missing_left", "gain", "cover", "gl", "hl")}
            found = found.unionByName(cells.where("feature = -1").select("at", "node", "feature", F.col("g").alias("gt"), F.col("h").alias("ht")).withColumns(none).withColumn("tree_total", F.lit(True)))
        table = found.toArrow().to_pylist()
        sent.destroy()
        previous, parents = cells, []
        for tree in plan.trees.values():
            tree.counted = [False] * len(tree.heap)
        for row in table:
            if row["tree_total"]:
                plan.trees[row["at"]].g[0], plan.trees[row["at"]].h[0] = row["gt"], row["ht"]
        for row in sorted((r for r in table if not r["tree_total"] and max_depth[r["at"]] >= level), key=lambda r: (r["at"], r["node"])):
            tree = plan.trees[row["at"]]
            tree.split(row["node"], row, max_depth[row["at"]] > level)
            out.append(row)
            if max_depth[row["at"]] > level:
                lighter = 2 * row["node"] + (not row["hl"] <= row["ht"] - row["hl"])
                parents.append((row["at"], row["node"], lighter ^ 1))
        if not parents:
            break
    return out
