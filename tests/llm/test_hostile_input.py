"""Columns that clash with names of the operators, malformed pages, repeated rows, rules that need several conditions."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociq.llm import chain, decision_list, html_diff, minhash, packing, radix, token_cache
from lociq.llm.queries import CATEGORIES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "Éa", "ranhe", "tion,", "thed", "über", "er"]) + rng.choice(["", "x", "yz"]) for _ in range(n))


CLASHES = ["_row", "_ROW_", "_null", "p_toxic", "p_toxic_junk", "p_low_quality", "offset", "sequence_id", "_open", "_dealt", "_block", "kept", "spans", "row", "id", "component_id", "batch"]


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [prose(1, 80), prose(1, 80), prose(2, 70) + " " + prose(9, 30), prose(3, 60) + " " + prose(9, 30), None, "", "bad bad words " * 9]
    rows = [(k if k != 1 else 0, t, "en", "s", len(t or ""), *range(100 * k, 100 * k + len(CLASHES))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)).repartition(3)


def test_stages_keep_columns_of_any_name(spark, clashing, tmp_path):
    spark.createDataFrame([(0, 1, 0), (6, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = CLASHES[0]
    before = {r[first]: tuple(r[c] for c in CLASHES) for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clashing, str(tmp_path))
        assert found.columns == clashing.columns, name
        rows = found.collect()
        assert rows and all(tuple(r[c] for c in CLASHES) == before[r[first]] for r in rows), name
    packed = packing.pack(packing.pieces(clashing, WORD_BPE, 64).withColumns({c: F.lit(1) for c in ("offset", "sequence_id", "_open", "_dealt", "_block", "key")}), 64)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 64 and {"_open", "_dealt", "_block", "key"} <= set(packed.columns)
    assert corpus_pipeline.packing_stage(spark, clashing, str(tmp_path)).count() == 7


def test_probabilities_replace_columns_of_their_names(spark, clashing):
    labels = spark.createDataFrame([(0, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    found = chain.toxicity(clashing, labels, CATEGORIES)
    assert found.schema["p_toxic"].dataType.typeName() == found.schema["p_low_quality"].dataType.typeName() == "double"
    assert len(found.columns) == len(clashing.columns) and found.count() == 7


def test_each_digest_is_encoded_once(spark, monkeypatch, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    counted = token_cache.counted

    def counting(texts, tokenizer, words):
        seen.add(texts.count())
        return counted(texts, tokenizer, words)

    monkeypatch.setattr(token_cache, "counted", counting)
    rows = [(1, "one text")] * 50 + [(None, "another")] * 50 + [(k, "a  third") for k in range(2, 40)] + [(99, "a third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = token_cache.token_counts(docs, WORD_BPE, f"file:{tmp_path}/c").collect()
    assert len(found) == len(rows) and seen.value == 3 and all(r.n_tokens > 0 for r in found)
    token_cache.token_counts(docs, WORD_BPE, f"file:{tmp_path}/c").collect()
    assert seen.value == 3


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "<p>x</p>" + "<a '" * 250_000 + ">", "<a \"" * 250_001 + ">", "<div>" * 200_000, "<b><i>" * 120_000 + "x", "<div><p>y" * 100_000 + "</span>" * 50_000, "<!--" * 250_000, "<p>a</p><!-- b <p>c</p>" * 40_000],
    ids=["no end", "apostrophes", "quotes", "nested", "inline", "unmatched", "comments", "open comment"],
)
def test_malformed_pages_take_seconds(page):
    started = time.time()
    html_diff.lines_of(page)
    assert time.time() - started < 10


@pytest.mark.parametrize(
    "page, want",
    [("<p>x</p> 1 < 2 <a", ["x", "1 < 2 <a"]), ("<p>x</p><!-- y", ["x"]), ("<p>x</p><!-- <p>y</p> z", ["x"]), ("<p>x</p><!-- y --> z", ["x", "z"]), ("<div><nav>a<div>b</div></nav>c</div>d", ["a", "b", "c", "d"]), ("no tags", ["no tags"])],
)
def test_ends_of_pages(page, want):
    assert [x.text for x in html_diff.lines_of(page)] == want


@pytest.mark.parametrize("most", [1, 3, 20_000])
def test_batches_share_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(radix, "MAX_BUCKETS", most)
    monkeypatch.setattr(radix, "BATCH_BYTES", 300)
    text = prose(5, 30)
    docs = spark.createDataFrame([(k, prose(k + 20, 40) + text) for k in range(12)], "doc_id long, text string")
    found = {r.doc_id: sum(s.bytes for s in r.spans) for r in radix.repeated_spans(docs).collect()}
    assert found[0] == 0 and all(found[k] >= len(text.encode()) for k in range(1, 12))


def test_rules_without_caps(spark):
    """Eleven kinds of rejected rows, each of its own symbol share and word count: more rules and conditions than any fixed few."""
    rng = random.Random(8)
    rows, kinds = [], 11
    for k in range(4_000):
        kind = k % (2 * kinds)
        words, symbols = 2 ** (kind % kinds % 4 + 4) + rng.randrange(3), 2 ** (kind % kinds // 4 + 3) + rng.randrange(2)
        rejected = kind < kinds
        # The same pairs with another share of repeated words are not rejected.
        rows.append((rng.randrange(3), rejected, words, symbols, 0, 40 if rejected else 2, 50, 400))
    noise = [(rng.randrange(3), rng.random() < 0.1, rng.randrange(1000, 1200), 0, 0, 90, 50, 400) for _ in range(300)]
    table = spark.createDataFrame(rows + noise, "part int, rejected boolean, " + ", ".join(f"{f} long" for f in decision_list.FEATURES))
    rules = decision_list.learn(table)
    assert max(len(r.conditions) for r in rules) >= 2
    verdict = table.withColumn("rule", F.expr(decision_list.case_expression(rules))).groupBy("rejected").agg(F.avg((F.col("rule") > 0).cast("double"))).collect()
    share = dict(map(tuple, verdict))
    assert share[True] > 0.95 and share[False] < 0.02


def test_two_rules_by_hand(spark):
    """Few words, or many symbols: one condition each, by plain counting the only pure ones."""
    rows = [(k % 3, w < 20 or s >= 40, w, s, 0, 0, 50, 400) for k, (w, s) in enumerate((w, s) for w in range(10, 200, 5) for s in range(0, 80, 4))]
    table = spark.createDataFrame(rows, "part int, rejected boolean, " + ", ".join(f"{f} long" for f in decision_list.FEATURES))
    rules = decision_list.learn(table)
    assert {(c.feature, c.at_least) for r in rules for c in r.conditions} == {("n_words", False), ("symbol_pct", True)} and len(rules) == 2
    wrong = table.withColumn("hit", F.expr(decision_list.case_expression(rules)) > 0).where("hit <> rejected").count()
    assert wrong <= 0.05 * len(rows)


def test_numbers_in_a_name_of_their_own(spark, clashing):
    rows, name = minhash.numbered(clashing)
    assert name not in clashing.columns and rows.select(name).distinct().count() == 7
