"""Tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lociq.operators import boost as B
from lociq.queries import query, rounded
from lociq.queries.learning import BOOSTED, IMPORTANCE_SQL, boosted
from lociq.queries.sql import CASES, draw, r6
from lociq.session import use_checkpoint_folder
from lociq.sources import tables as IO
from lociq.sources.fixtures import cases, given_scores, table


def scratch(spark):
    return f"{use_checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4()}"


@query("read_delimited", f"SELECT CAST(p_partkey AS BIGINT) AS case_id, p_name, CASE WHEN p_size > 25 THEN p_type END AS p_type, CAST(p_size AS INTEGER) AS p_size, {r6('p_retailprice', 'price')} FROM part")
def _(spark, folder):
    """Parts through a tab-separated file: the key first, NA for missing."""
    path = scratch(spark)
    parts = table(spark, folder, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"), F.col("p_size").cast("int").alias("p_size"), F.col("p_retailprice").alias("price"))
    IO.write_tsv(parts, path)
    return rounded(IO.first_column_as_key(IO.read_delimited(spark, path, "p_partkey long, p_name string, p_type string, p_size int, price double")))


@query("keep_na_text", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NA' WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderpriority END AS priority FROM orders")
def _(spark, folder):
    """The text NA and empty text as categories."""
    path = scratch(spark)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "NA").when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_orderpriority"))
    IO.write_tsv(table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), kind.alias("priority")), path)
    return IO.read_delimited(spark, path, "case_id string, priority string", keep_na=True)


@query("read_coordinates", f"WITH {CASES} SELECT case_id, chrom, coord FROM cases")
def _(spark, folder):
    """Cases of both labels in a file each, stacked."""
    base, rows = scratch(spark), cases(spark, folder)
    for label in (0, 1):
        IO.write_tsv(rows.where(F.col("label") == label).select("case_id", "chrom", F.col("coord").alias("chromStart"), "label"), f"{base}/{label}")
    schema = "case_id long, chrom string, chromStart long, label int"
    return IO.read_coordinates(spark, [f"{base}/0", f"{base}/1"], schema, ["case_id", "chrom", "chromStart"], {"chromStart": "coord"})


@query("feature_tables", "SELECT vec_id AS case_id, CAST(label >= 5 AS INTEGER) AS label, len(embedding) AS n FROM embeddings")
def _(spark, folder):
    """A feature table through a stage in Parquet."""
    from lociq.sources.fixtures import embedding_features

    base = scratch(spark)
    IO.stage(embedding_features(spark, folder), base, "features")
    return IO.read_table(spark, f"{base}/features").select("case_id", "label", F.size("features").cast("long").alias("n"))


@query(
    "results_by_seed",
    f"""WITH {CASES}, scores AS (SELECT set_name, CASE set_name WHEN 'value' THEN score WHEN 'negated' THEN -score ELSE {draw("CAST(case_id AS VARCHAR)")} END AS s
      FROM cases, (SELECT unnest(['value', 'negated', 'hashed']) AS set_name))
    SELECT label, CAST(seed AS INTEGER) AS seed, set_name AS set_type, {r6("max(s) * seed", "top")}, count(*) AS cases
    FROM scores, (VALUES ('tune', 1337), ('tune', 7), ('compare', 1337)) v(label, seed) GROUP BY label, seed, set_name""",
)
def _(spark, folder):
    """Results of three runs under their label and seed, read back with both from the path."""
    base = scratch(spark)
    best = given_scores(cases(spark, folder)).groupBy(F.col("set_name").alias("set_type")).agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("cases"))
    for label, seed in (("tune", 1337), ("tune", 7), ("compare", 1337)):
        IO.write_results(best.withColumn("top", F.col("top") * seed), base, label, seed)
    return rounded(IO.read_results(spark, base))


@query("write_importance", f"{BOOSTED} SELECT {IMPORTANCE_SQL} FROM b_splits GROUP BY task_id, feature WINDOW t AS (PARTITION BY task_id)")
def _(spark, folder):
    """Importance as tab-separated files by task, read back with the task from the path."""
    path = scratch(spark)
    IO.write_importance(rounded(B.split_importance(boosted(spark, folder).splits)), path, ["task_id"])
    kept = IO.read_delimited(spark, path, "feature long, gain double, cover double, frequency double, task_id int")
    return kept.select("task_id", "feature", "gain", "cover", "frequency")
