import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lociq.functions.scalars import hp_text
from lociq.operators import encode as E
from lociq.operators import quality as Q
from lociq.operators import tasks as T
from lociq.plans import configurations as C
from lociq.sources import tables as IO


def lines(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".csv"):
            with open(os.path.join(folder, name)) as f:
                out += f.read().splitlines()
    return out


@pytest.fixture
def delimited(tmp_path):
    path = tmp_path / "features.tsv"
    path.write_text("name\tlabel\tallele\tgc\nrs1\t1\tNA\t0.5\nrs2\t0\t\tNA\nrs3\t0\tA\t0.25\n")
    return str(path)


SCHEMA = "name string, label int, allele string, gc double"


def test_na_is_missing_or_kept(spark, delimited):
    df = IO.first_column_as_key(IO.read_delimited(spark, delimited, SCHEMA))
    assert df.columns[0] == "case_id"
    assert [r["allele"] for r in df.orderBy("case_id").collect()] == [None, None, "A"]
    text = SCHEMA.replace("gc double", "gc string")
    kept = IO.read_delimited(spark, delimited, text, keep_na=True).orderBy("name").collect()
    assert [(r["allele"], r["gc"]) for r in kept] == [("NA", "0.5"), ("", "NA"), ("A", "0.25")]


def test_text_in_a_number_column_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("name\tlabel\nrs1\tx\n")
    with pytest.raises(Exception):
        IO.read_delimited(spark, str(path), "name string, label int").collect()


def test_coordinates_of_two_files(spark, tmp_path):
    for name, rows in {"c": "rs1\t5\tz\n", "r": "rs2\t9\tz\n"}.items():
        (tmp_path / f"{name}.tsv").write_text("name\tchromStart\tother\n" + rows)
    paths = [str(tmp_path / "c.tsv"), str(tmp_path / "r.tsv")]
    df = IO.read_coordinates(spark, paths, "name string, chromStart bigint, other string", ["name", "chromStart"], {"chromStart": "coord"})
    assert sorted(map(tuple, df.collect())) == [("rs1", 5), ("rs2", 9)] and df.columns == ["name", "coord"]


def test_restrict_keeps_missing_keys_as_null(spark):
    left = spark.createDataFrame([(1, 2.0)], "case_id int, x double")
    keys = spark.createDataFrame([(1,), (3,)], "case_id int")
    assert sorted(map(tuple, IO.restrict_to(left, keys).collect()), key=str) == [(1, 2.0), (3, None)]


def test_stage_and_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "XGB", 0.5), (2, "ranger", 0.25)], "config_id int, set_type string, v double")
    again = IO.stage(df, str(tmp_path), "step")
    assert again.exceptAll(df).count() == 0 and again.count() == 2
    path = IO.write_results(df, str(tmp_path / "out"), "tune", 1337)
    assert path.endswith("out/label=tune/seed=1337")
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["set_type=XGB", "set_type=ranger"]


def test_tsv_is_plain(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c=1', None)], "id int, hp string, p double").coalesce(1)
    IO.write_tsv(df, str(tmp_path / "t"))
    assert lines(tmp_path / "t") == ["id\thp\tp", '1\ta "b", c=1\tNA']
    imp = spark.createDataFrame([("XGB", "main", 3, 0.5)], "set_type string, config_name string, feature int, gain double")
    IO.write_importance(imp, str(tmp_path / "i"))
    assert lines(tmp_path / "i" / "set_type=XGB" / "config_name=main") == ["feature\tgain", "3\t0.5"]


def test_a_tab_in_a_text_is_refused(spark, tmp_path):
    for text in ("a\tb", "a\nb", "a\rb"):
        with pytest.raises(Exception, match="a tab or line break in column hp"):
            IO.write_tsv(spark.createDataFrame([(1, text)], "id int, hp string"), str(tmp_path / "t"))


def test_values_of_all_columns_in_one_pass(spark):
    df = spark.createDataFrame([("x,y", "a", 1), ("y,,z", None, 2), (None, "", 3)], "tokens string, kind string, n int")
    assert E.categories(df, {"tokens": ",", "kind": None}) == {"tokens": ["x", "y", "z"], "kind": ["", "a"]}
    many = spark.range(12_000).select(F.col("id").alias("case_id"), F.lit(0).alias("label"), F.col("id").cast("string").alias("kind"))
    assert len(E.categories(many, {"kind": None})["kind"]) == 12_000


def test_binary_encoding_of_token_lists(spark):
    df = spark.createDataFrame([(1, "ARID3A,ATF1,ATF2"), (2, "ARID3A"), (3, None)], "case_id int, tf string")
    out = E.binary_encode(df, "tf", ",", "tf_", integrate=True).orderBy("case_id")
    assert out.columns == ["case_id", "tf_ARID3A", "tf_ATF1", "tf_ATF2"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 1, 1), (1, 0, 0), (0, 0, 0)]
    pipes = spark.createDataFrame([(1, "a|b")], "case_id int, tf string")
    assert E.binary_encode(pipes, "tf", "|").columns == ["a", "b"]


def test_model_matrix_keeps_all_values_of_the_first_category_only(spark):
    df = spark.createDataFrame([(1, 0, "a", "x", 2.0), (2, 1, "b", "y", None)], "case_id int, label int, f string, g string, v double")
    made, names = E.model_matrix(df)
    assert names == ["fa", "fb", "gy", "v"]
    rows = [r["a"] for r in made.orderBy("case_id").select(vector_to_array("features").alias("a")).collect()]
    assert rows[0] == [1, 0, 0, 2] and rows[1][:3] == [0, 1, 1] and rows[1][3] != rows[1][3]


def test_impute_handles_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 2.0)], "case_id int, x double")
    assert sorted(r["x"] for r in E.impute_mean(df, ["x"]).collect()) == [1.0, 1.5, 1.5, 2.0]


def test_quality_flags_wide_categories(spark):
    df = spark.range(70).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("x"))
    report = {r["feature"]: r for r in Q.feature_quality(df).collect()}
    assert not report["c"]["ok"] and report["c"]["levels"] == 70 and report["x"]["ok"]
    with pytest.raises(ValueError, match="1 missing"):
        Q.require_complete(spark.createDataFrame([(None,), (1.0,)], "x double"))


def test_grid_order_and_recycled_pairs(spark):
    base = spark.range(1).select(F.lit(0.5).alias("b"))
    values = {"a": [1, 2], "c": [10, 20]}
    last = [(r["a"], r["c"]) for r in T.grid(base, values).orderBy("hp_no").collect()]
    first = [(r["a"], r["c"]) for r in T.grid(base, values, fastest="first").orderBy("hp_no").collect()]
    assert last == [(1, 10), (1, 20), (2, 10), (2, 20)] and first == [(1, 10), (2, 10), (1, 20), (2, 20)]
    points = T.pair_parameters(T.grid(base, values), [{"w": 1}, {"w": 2}, {"w": 3}]).orderBy("hp_no")
    assert [r["w"] for r in points.collect()] == [1, 2, 3, 1]
    assert T.pair_parameters(T.grid(base, values), [{"w": 1}, {"w": 2}], how="product").count() == 8


def test_parameter_text_is_sorted(spark):
    df = spark.range(1).select(F.create_map(F.lit("eta"), F.lit(0.1), F.lit("alpha"), F.lit(20.0)).alias("hp"))
    assert df.select(hp_text("hp")).first()[0] == "alpha=20.0, eta=0.1"


def test_published_lists(spark):
    balance = spark.createDataFrame([(0.1,)], "fraction_positive double")
    configs = C.comparison(balance)
    assert configs.count() == 14 and C.comparison(balance, C.COMPARISON_NEWER).count() == 3
    assert C.tuning_grid(balance).count() == 4608
    both = C.objective_grid(balance)
    assert both.count() == 2 * 2304 and both.where("hp['bandwidth'] IS NULL").count() == 2304
    tasks = T.task_table(configs, 200, 10)
    assert tasks.agg(F.min("task_id"), F.max("task_id"), F.count_distinct("task_id")).first() == (1, 28_000, 28_000)


def test_registry(spark):
    with pytest.raises(KeyError, match="not registered"):
        T.resolve({"XGB": 1}, "ranger")
    configs = spark.createDataFrame([("a",), ("b",), (None,)], "matrix string")
    assert [r["matrix"] for r in T.unresolved_names(configs, "matrix", ["a"], spark).collect()] == ["b"]
