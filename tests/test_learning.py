import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociq.operators import boost as B
from lociq.operators import cuts as C
from lociq.operators import objective as O
from lociq.operators.joins import salted_join


def pair_sums(x, y, group, b):
    """Gradient and Hessian straight from the definition."""
    d = x[:, None] - x[None, :]
    k = np.exp(-(d**2) / b**2) / (b * np.sqrt(np.pi)) * ((y[:, None] != y[None, :]) & (group[:, None] == group[None, :]))
    g, h = np.where(y == 1, -1, 1) * k.sum(1), 2 / b**2 * ((abs(d) + b) * k).sum(1)
    alone = ~((y[:, None] != y[None, :]) & (group[:, None] == group[None, :])).any(1)
    p = 1 / (1 + np.exp(-x))
    return np.where(alone, p - y, g), np.where(alone, p * (1 - p), h)


@pytest.mark.parametrize("b", [0.1, 1.0])
def test_rank_objective_equals_pair_sums(spark, b):
    rng = np.random.default_rng(3)
    n = 900
    x = np.where(rng.random(n) < 0.2, 0.5, np.round(rng.normal(size=n) * 2, 2))
    y = rng.integers(0, 2, n)
    group = np.where(rng.random(n) < 0.4, "hot", [f"l{i}" for i in rng.integers(0, 300, n)])
    df = spark.createDataFrame(pd.DataFrame({"t": 1, "case_id": range(n), "locus_id": group, "label": y, "pred": x}))
    got = O.rank_objective(df, ["t"], b).toPandas().sort_values("case_id")
    g, h = pair_sums(x, y, group, b)
    assert np.abs(got.grad.to_numpy() - g).max() < 1e-9
    assert np.abs(got.hess.to_numpy() - h).max() < 1e-8


def test_rank_objective_by_hand(spark):
    rows = [(1, 1, "a", 1, 0.0), (1, 2, "a", 0, 0.0), (1, 3, "b", 1, 0.0)]
    df = spark.createDataFrame(rows, "t int, case_id int, locus_id string, label int, pred double")
    got = {r["case_id"]: (r["grad"], r["hess"]) for r in O.rank_objective(df, ["t"], 1.0).collect()}
    assert got[1] == (pytest.approx(-0.564190, abs=1e-6), pytest.approx(1.128379, abs=1e-6))
    assert got[2] == (pytest.approx(0.564190, abs=1e-6), pytest.approx(1.128379, abs=1e-6))
    assert got[3] == (-0.5, 0.25)


def grow(x, y, train, p, cuts):
    """The same trees by plain loops: margins of all cases."""
    bins = np.where(np.isnan(x), -1, (x[:, :, None] > np.array(cuts)).sum(-1))
    margin = np.full(len(y), np.log(p["base_score"] / (1 - p["base_score"])))
    for _ in range(p["nrounds"]):
        prob = 1 / (1 + np.exp(-margin))
        g, h = (prob - y) * train, prob * (1 - prob) * train
        node = np.ones(len(y), int)
        for _ in range(p["max_depth"]):
            new = node.copy()
            for k in np.unique(node):
                at, best = node == k, None
                G, H = g[at].sum(), h[at].sum()
                for f in range(x.shape[1]):
                    for j in range(-1, len(cuts) + 1):
                        for missing_left in (True, False):
                            b = bins[:, f]
                            left = at & np.where(b == -1, missing_left, b <= j)
                            gl, hl = g[left].sum(), h[left].sum()
                            if hl < 1 or H - hl < 1:
                                continue
                            gain = (gl**2 / (hl + p["lambda"]) + (G - gl) ** 2 / (H - hl + p["lambda"]) - G**2 / (H + p["lambda"])) / 2 - p["gamma"]
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, j, missing_left)
                if best:
                    _, f, j, missing_left = best
                    b = bins[:, f]
                    left = np.where(b == -1, missing_left, b <= j)
                    new[at] = 2 * k + ~left[at]
            node = new
        for k in np.unique(node):
            at = node == k
            margin[at] -= p["eta"] * g[at].sum() / (h[at].sum() + p["lambda"])
    return margin


@pytest.mark.parametrize("block", [256, 1])
def test_boosting_equals_plain_loops(spark, block):
    rng = np.random.default_rng(5)
    n, cuts = 120, [-0.5, 0.0, 0.5]
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) * 0.5 > 0).astype(int)
    points = [
        {"eta": 0.3, "nrounds": 2, "lambda": 1.0, "gamma": 0.0, "max_depth": 2, "base_score": 0.4},
        {"eta": 0.1, "nrounds": 1, "lambda": 5.0, "gamma": 0.2, "max_depth": 1, "base_score": 0.5},
    ]
    df = spark.createDataFrame([(i, int(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)], "case_id int, label int, features array<double>")
    members = spark.createDataFrame([(t, i, "train" if (i + t) % 3 else "test") for t in (0, 1) for i in range(n)], "task_id int, case_id int, role string")
    tasks = spark.createDataFrame([(t, {k: float(v) for k, v in p.items()}) for t, p in enumerate(points)], "task_id int, hp map<string,double>")
    out = B.newton_boost(B.binned(df, [cuts] * 3), members, B.task_settings(tasks), [cuts] * 3, block_tasks=block)
    got = out.scores.toPandas().sort_values(["task_id", "case_id"])
    for t, p in enumerate(points):
        train = np.array([(i + t) % 3 != 0 for i in range(n)])
        assert np.allclose(got.margin[got.task_id == t], grow(x, y, train, p, cuts), atol=1e-9)
    shares = B.split_importance(out.splits).groupBy("task_id").agg(F.sum("gain"), F.sum("cover"), F.sum("frequency")).collect()
    assert shares and all(v == pytest.approx(1.0) for r in shares for v in tuple(r)[1:])


def test_boosting_takes_the_rank_objective(spark):
    rng = np.random.default_rng(9)
    n = 90
    df = spark.createDataFrame([(i, f"l{i // 5}", int(i % 5 == 0), [float(v) for v in rng.normal(size=2) + (i % 5 == 0)]) for i in range(n)], "case_id int, locus_id string, label int, features array<double>")
    members = spark.createDataFrame([(t, i, "train" if i // 5 % 3 else "test") for t in (1, 2, 3) for i in range(n)], "task_id int, case_id int, role string")
    hp = {"nrounds": 1.0, "max_depth": 1.0, "eta": 1.0, "min_child_weight": 0.1}
    tasks = spark.createDataFrame([(1, {**hp, "bandwidth": 0.5}), (2, hp), (3, {**hp, "bandwidth": 2.0})], "task_id int, hp map<string,double>")
    cuts = B.quantile_cuts(df, 2, 4)
    cases = B.binned(df, cuts)
    out = B.newton_boost(cases, members, B.task_settings(tasks), cuts)
    first = {r.task_id: r for r in out.splits.collect()}
    assert out.scores.count() == 3 * n and len(first) == 3 and out.scores.where("task_id = 1").select("margin").distinct().count() == 2
    # Only tasks with a bandwidth use pairs: the gradient sums of the root are those of each objective alone.
    cover = {t: O.rank_objective(df.join(members.where(f"task_id = {t} AND role = 'train'"), "case_id").withColumn("pred", F.lit(0.0)), ["task_id"], b).agg(F.sum("hess")).first()[0] for t, b in ((1, 0.5), (3, 2.0))}
    assert first[1].cover == pytest.approx(cover[1]) and first[3].cover == pytest.approx(cover[3]) and first[2].cover == pytest.approx(60 * 0.25)
    given = B.newton_boost(cases, members, B.task_settings(tasks), cuts, objective=lambda train: O.rank_objective(train, ["task_id"], 0.5))
    assert [r.cover for r in given.splits.collect()] == [pytest.approx(cover[1])] * 3


def test_state_does_not_grow_with_tasks_times_features(spark, tmp_path):
    def written(width, tasks):
        df = spark.range(400).select(F.col("id").alias("case_id"), (F.col("id") % 2).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.xxhash64("id", k).cast("double")).alias("features"))
        members = df.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(tasks))).alias("task_id"), F.lit("train").alias("role"))
        points = spark.range(1, tasks + 1).select(F.col("id").cast("int").alias("task_id"), F.create_map(F.lit("nrounds"), F.lit(1.0), F.lit("max_depth"), F.lit(1.0)).alias("hp"))
        cuts, sizes = [[0.0]] * width, []
        keep, boost_written = B.discard, B._written

        def count(table, path):
            out = boost_written(table, path)
            sizes.append(sum(f.stat().st_size for f in __import__("pathlib").Path(path.removeprefix("file:")).glob("*.parquet")))
            return out

        B._written, B.discard = count, lambda *_: None
        try:
            B.newton_boost(B.binned(df, cuts), members, B.task_settings(points), cuts)
        finally:
            B._written, B.discard = boost_written, keep
        return sum(sizes)

    narrow, wide, many, both = written(2, 2), written(100, 2), written(2, 40), written(100, 40)
    assert both < 1.2 * (wide + many - narrow)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, parts):
    rng = np.random.default_rng(1)
    n = 3_000
    x = np.stack([rng.normal(size=n), np.exp(rng.normal(size=n) * 40), 1e6 + rng.random(n) * 1e-6, rng.integers(0, 3, n), np.full(n, -0.0), np.where(rng.random(n) < 0.5, np.nan, -rng.random(n)), np.full(n, np.nan)], 1)
    x[:10, 0], x[10:20, 0] = np.inf, -np.inf
    rows = [([None if np.isnan(v) and i % 2 else float(v) for v in r],) for i, r in enumerate(x)] + [(None,)]
    got = C.exact_quantiles(spark.createDataFrame(rows, "features array<double>").repartition(parts), 7, 8)
    for f in range(7):
        v = np.sort(x[~np.isnan(x[:, f]), f])
        assert got[f] == [float(v[-(-i * len(v) // 8) - 1]) if len(v) else None for i in range(1, 8)]
    assert C.exact_quantiles(spark.createDataFrame([], "features array<double>"), 2, 4) == [[None] * 3] * 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_join(spark, how):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = rows.join(small, "k", how)
    got = salted_join(rows, small, ["k"], how)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
