"""Encoding, cleaning and checks of feature tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lociq.operators import encode as E
from lociq.operators import quality as Q
from lociq.queries import query, rounded
from lociq.queries.sql import CASES, draw, r6
from lociq.sources.fixtures import cases, embedding_features, given_scores, role_sets, table

ROLES = """roles AS (SELECT conv_id AS case_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id)"""
# Categories of the given tables, as they appear in the SQL of the wide encodings.
ROLE_NAMES = ["assistant", "system", "user"]
TYPE_NAMES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
LANGS = ["de", "en", "es", "fr"]


def as_rows(df, names, label="label"):
    """A vector column as (case_id, label, feature, value) rows."""
    packed = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), vector_to_array("features").alias("value"))
    return df.select("case_id", label, F.explode(packed).alias("_z")).select("case_id", label, F.col("_z.feature"), F.col("_z.value"))


def parts(spark, folder):
    """Parts as a feature table with two category columns and two numbers."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("case_id"),
        (F.col("p_size") > 25).cast("int").alias("label"),
        "p_type",
        "p_brand",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
    )


def labelled_documents(spark, folder):
    """Documents with their labels; unlabelled ones have missing values."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("case_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"),
    )


LABELLED = "lab AS (SELECT d.doc_id AS case_id, n_chars::DOUBLE AS n_chars, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(
    "binary_encode",
    f"""WITH {ROLES} SELECT case_id, {", ".join(f"CAST(list_contains(string_split(roles, ','), '{t}') AS INTEGER) AS role_{t}" for t in ROLE_NAMES)} FROM roles""",
)
def _(spark, folder):
    return E.binary_encode(role_sets(spark, folder), "roles", ",", prefix="role_", integrate=True)


@query(
    "binary_encode_long",
    """SELECT DISTINCT conv_id AS case_id, 'role_' || role AS feature, 1 AS value FROM conversations""",
)
def _(spark, folder):
    return E.encode_long(role_sets(spark, folder), "case_id", "roles", ",", "role_")


@query(
    "one_hot",
    f"""SELECT p_partkey AS case_id, p_retailprice, {", ".join(f"CAST(p_type = '{v}' AS INTEGER) AS type_{v}" for v in TYPE_NAMES)} FROM part""",
)
def _(spark, folder):
    df = table(spark, folder, "part").select(F.col("p_partkey").alias("case_id"), "p_retailprice", "p_type")
    return E.one_hot_encode(df, "p_type", prefix="type_", integrate=True)


@query("one_hot_long", "SELECT o_orderkey AS case_id, 'prio_' || o_orderpriority AS feature, 1 AS value FROM orders")
def _(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderpriority")
    return E.encode_long(df, "case_id", "o_orderpriority", prefix="prio_")


@query(
    "chrom_flags",
    f"""SELECT doc_id AS case_id, {", ".join(f"CAST(lang = '{v}' AS INTEGER) AS chrom{v}" for v in LANGS)} FROM documents""",
)
def _(spark, folder):
    df = table(spark, folder, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("chrom"))
    return E.chrom_flags(df)


@query(
    "model_matrix",
    """WITH p AS (SELECT p_partkey AS case_id, CAST(p_size > 25 AS INTEGER) AS label, p_type, p_brand, p_size::DOUBLE AS s, p_retailprice AS r FROM part),
    brands AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand > (SELECT min(p_brand) FROM part)),
    types AS (SELECT DISTINCT p_type AS v FROM part)
    SELECT case_id, label, 'p_type' || v AS feature, (p_type = v)::DOUBLE AS value FROM p, types
    UNION ALL SELECT case_id, label, 'p_brand' || v, (p_brand = v)::DOUBLE FROM p, brands
    UNION ALL SELECT case_id, label, 'p_size', s FROM p
    UNION ALL SELECT case_id, label, 'p_retailprice', round(r, 6) FROM p""",
)
def _(spark, folder):
    made, names = E.model_matrix(parts(spark, folder))
    return rounded(as_rows(made, names))


@query(
    "numeric_matrix",
    """SELECT p_partkey AS case_id, CAST(p_size > 25 AS INTEGER) AS label, unnest(['p_size', 'p_retailprice']) AS feature,
    unnest([p_size::DOUBLE, round(p_retailprice, 6)]) AS value FROM part""",
)
def _(spark, folder):
    df = parts(spark, folder).drop("p_type", "p_brand")
    return rounded(as_rows(E.numeric_vector(df), ["p_size", "p_retailprice"]))


@query(
    "clean_columns",
    "SELECT p_partkey AS case_id, CAST(p_size > 25 AS INTEGER) AS label, p_size AS coord FROM part",
)
def _(spark, folder):
    df = table(spark, folder, "part").withColumn("cls", (F.col("p_size") > 25).cast("int").cast("string"))
    df = df.drop("p_name", "p_brand", "p_type", "p_retailprice").withColumnsRenamed({"p_partkey": "case_id", "cls": "label", "p_size": "coord"})
    return Q.label_as_int(df)


@query(
    "impute_mean",
    f"""WITH {LABELLED} SELECT case_id, n_chars, {r6("coalesce(quality, (SELECT avg(quality) FROM lab))", "quality")},
    {r6("coalesce(toxic, (SELECT avg(toxic) FROM lab))", "toxic")} FROM lab""",
)
def _(spark, folder):
    return rounded(E.impute_mean(labelled_documents(spark, folder), ["quality", "toxic"]))


@query(
    "feature_quality",
    """WITH p AS (SELECT *, CASE WHEN p_size = 13 THEN 'nan'::DOUBLE ELSE p_retailprice END AS price FROM part)
    SELECT 'price' AS feature, count(*) FILTER (isnan(price)) AS nan_count, CAST(0 AS BIGINT) AS null_count, CAST(0 AS BIGINT) AS levels, count(*) FILTER (isnan(price)) = 0 AS ok FROM p
    UNION ALL SELECT 'p_brand', 0, 0, count(DISTINCT p_brand), count(DISTINCT p_brand) <= 64 FROM p
    UNION ALL SELECT 'p_name', 0, 0, count(DISTINCT p_name), count(DISTINCT p_name) <= 64 FROM p
    UNION ALL SELECT 'p_size', 0, 0, 0, true""",
)
def _(spark, folder):
    price = F.when(F.col("p_size") == 13, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    df = table(spark, folder, "part").select(price.alias("price"), "p_brand", "p_name", "p_size")
    return Q.feature_quality(df)


@query(
    "feature_quality_matrix",
    """SELECT 'p_partkey' AS feature, 0::BIGINT AS nan_count, 0::BIGINT AS null_count, count(DISTINCT p_partkey) AS levels, count(DISTINCT p_partkey) <= 64 AS ok FROM part
    UNION ALL SELECT 'p_size', 0, 0, count(DISTINCT p_size), count(DISTINCT p_size) <= 64 FROM part""",
)
def _(spark, folder):
    return Q.feature_quality(table(spark, folder, "part").select("p_partkey", "p_size"), matrix=True)


@query(
    "missing_values",
    f"WITH {LABELLED} SELECT count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL) AS missing, count(quality) = count(*) AS ok FROM lab",
)
def _(spark, folder):
    return Q.missing_values(labelled_documents(spark, folder))


@query(
    "table_alignment",
    """WITH a AS (SELECT doc_id, CAST(n_chars > 500 AS INTEGER) AS label FROM documents)
    SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (a.doc_id IS NULL) AS only_right,
    count(*) FILTER (a.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND a.label IS DISTINCT FROM l.quality) AS label_differs,
    count(*) FILTER (a.doc_id IS NULL OR l.doc_id IS NULL OR a.label IS DISTINCT FROM l.quality) = 0 AS ok
    FROM a FULL JOIN labels l ON a.doc_id = l.doc_id""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("case_id"), (F.col("n_chars") > 500).cast("int").alias("label"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("label"))
    return Q.table_alignment(docs, labels)


@query(
    "table_sizes",
    """WITH t AS (SELECT 'documents' AS name, count(*) AS cases FROM documents UNION ALL SELECT 'labels', count(*) FROM labels)
    SELECT name, cases, (SELECT count(DISTINCT cases) = 1 FROM t) AS equal FROM t""",
)
def _(spark, folder):
    return Q.table_sizes({n: table(spark, folder, n) for n in ("documents", "labels")})


@query(
    "class_balance",
    f"""WITH {CASES} SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
    {r6("sum(1 - label) / sum(label)", "negative_per_positive")}, {r6("sum(label) / count(*)", "fraction_positive")} FROM cases""",
)
def _(spark, folder):
    return rounded(Q.class_balance(cases(spark, folder)))


@query(
    "combine_matrices",
    f"""WITH e AS (SELECT vec_id AS case_id, CAST(label >= 5 AS INTEGER) AS label,
      list_concat(embedding::DOUBLE[], [{draw("CAST(vec_id AS VARCHAR)")}, vec_id::DOUBLE]) AS f FROM embeddings)
    SELECT case_id, label, unnest(range(0, len(f))) AS feature, round(unnest(f), 6) + 0.0 AS value FROM e""",
)
def _(spark, folder):
    from lociq.functions.draws import uniform

    base = embedding_features(spark, folder)
    extra = base.select("case_id", F.array(uniform("case_id"), F.col("case_id").cast("double")).alias("reduced"))
    made = E.combine_matrices(base, extra)
    return rounded(made.select("case_id", "label", F.posexplode(vector_to_array("features")).alias("_i", "value")).select(
        "case_id", "label", F.col("_i").cast("bigint").alias("feature"), "value"))


@query(
    "filter_cases",
    f"WITH {CASES} SELECT case_id, chrom, label FROM cases WHERE label = 1 AND chrom IN ('1', '2', '3', '5', '8', '13') AND score >= 0.4",
)
def _(spark, folder):
    wanted = F.col("chrom").isin("1", "2", "3", "5", "8", "13")
    return cases(spark, folder).where((F.col("label") == 1) & wanted & (F.col("score") >= 0.4)).select("case_id", "chrom", "label")


@query(
    "given_score_rows",
    f"""WITH {CASES} SELECT 1 AS config_id, 'value' AS set_name, case_id, round(score, 6) AS score FROM cases
    UNION ALL SELECT 2, 'negated', case_id, round(-score, 6) + 0.0 FROM cases
    UNION ALL SELECT 3, 'hashed', case_id, round({draw("CAST(case_id AS VARCHAR)")}, 6) FROM cases""",
)
def _(spark, folder):
    return rounded(given_scores(cases(spark, folder)))
