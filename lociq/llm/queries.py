"""Queries of the pipeline operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm import bag_search, chain, conversation_trie, decision_list, html_diff, lattice, minhash, owner_trie, packing, radix, token_cache, warc, wu_manber
from lociq.session import use_checkpoint_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 2048
#: Categories in the order of the chain, as conditions over the labels. The verdict is that of the last, whose model sees the probability of the other.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
TOXIC = 0.5


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.archive_round_trip(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = minhash.near_duplicates(_table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, summed over all its segmentations."""
    return lattice.lattice_scores(_table(spark, folder, "documents"), PIECES)


def op4_digest_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document, through a cache that begins empty."""
    cache = f"{use_checkpoint_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4()}"
    counts = token_cache.token_counts(_table(spark, folder, "documents"), WORD_BPE, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the base rule and the learned list for every document."""
    found = decision_list.quality_verdicts(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html_diff.main_texts(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_classifier_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity probabilities and verdict of every document."""
    found = chain.toxicity(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"), CATEGORIES)
    return found.select("doc_id", *(f"p_{c}" for c in CATEGORIES), (F.col("p_toxic") >= TOXIC).alias("toxic"), (F.col("p_toxic") < TOXIC).alias("kept"))


def op8_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    return wu_manber.contamination(wu_manber.occurrences(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op9_radix_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document."""
    found = radix.repeated_spans(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in a sequence."""
    made = packing.pieces(_table(spark, folder, "documents"), WORD_BPE, TOKEN_LIMIT, with_ids=False)
    return packing.pack(made.drop("ids"), TOKEN_LIMIT)


def op11_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return bag_search.ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_vertical_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the conversations with shared heads."""
    turns = conversation_trie.turns_in_order(_table(spark, folder, "conversations"))
    return conversation_trie.prefix_nodes(conversation_trie.with_shared_heads(turns)).drop("path")


def op13_owner_tries(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays of all with the same text, for every document."""
    found = owner_trie.exact_copies(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_chunks, op2_minhash_join, op3_subword_lattice, op4_digest_cache, op5_decision_list, op6_page_differencing, op7_classifier_chain, op8_wu_manber, op9_radix_suffixes, op10_sum_of_squares, op11_bag_search, op12_vertical_bitmaps, op13_owner_tries)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_warc_chunks": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1) FOR k IN range(32)], '') AS payload_digest,
            CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM f""",
    "op2_minhash_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT pairs.a, pairs.b FROM pairs JOIN n x ON x.doc_id = pairs.a JOIN n y ON y.doc_id = pairs.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op8_wu_manber": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, l, unnest([array_to_string(w[i : i + l - 1], ' ') FOR i IN range(1, len(w) - l + 2)]) AS s
            FROM (SELECT *, least(13, len(w)) AS l FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS s
            FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))),
        hits AS (SELECT DISTINCT doc_id, item_id, i, dw.l AS l FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items.x, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op9_radix_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(len(h) // 1000 + 1)) AS k FROM d)),
        w AS (SELECT doc_id, 500 * k + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, k, h, unnest(range(len(h) // 2 - 49)) AS i FROM c)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        r AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS new FROM w JOIN f ON f.s = w.s WHERE first < doc_id),
        g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM r),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
        total AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id),
        gaps AS (SELECT spans.doc_id, a AS o, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0))) AS x FROM spans JOIN d ON d.doc_id = spans.doc_id),
        tails AS (SELECT d.doc_id, len(h) AS o, substr(h, 2 * coalesce(max(b), 0) + 1) AS x FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id, h),
        kept AS (SELECT doc_id, string_agg(x, '' ORDER BY o) AS x FROM (SELECT * FROM gaps UNION ALL SELECT * FROM tails) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
        FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN total ON total.doc_id = d.doc_id""",
    "op11_bag_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
        c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
        f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
        v AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
        s AS (SELECT item_id, doc_id, CAST(sum(q.q * v.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * f.n * c.n) // c.l))))) AS BIGINT) AS score
            FROM f JOIN q USING (t) JOIN v USING (t), c GROUP BY ALL HAVING score > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_vertical_bitmaps": """
        WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
            sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS many, conv_id - conv_id % 100 AS base,
            xor(list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda x, b:
                list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 6 AS h FROM o GROUP BY conv_id),
        e AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.many, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
        t AS (SELECT e.conv_id, p, k, chars FROM e JOIN o ON o.conv_id = e.base AND p <= h UNION ALL SELECT e.conv_id, taken + p - h, k, chars FROM e JOIN o ON o.conv_id = e.conv_id AND p > h),
        a AS (SELECT conv_id, p AS d, string_agg(k, '' ORDER BY p) OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS path, chars FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM e),
        m AS (SELECT conv_id, d, sha256(path) AS path, sha256(substr(path, 1, 64 * (d - 1))) AS above, chars, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM a),
        n AS (SELECT path, any_value(d) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
            coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM m GROUP BY path),
        kids AS (SELECT above AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY above),
        below AS (SELECT DISTINCT x.path AS top, y.path AS path FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.d >= x.d),
        s AS (SELECT top, count(*) FILTER (kids.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved FROM below JOIN n USING (path) LEFT JOIN kids USING (path) GROUP BY top)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s ON s.top = n.path LEFT JOIN kids ON kids.path = n.path LEFT JOIN n p ON p.path = n.above AND n.depth > 0""",
    "op13_owner_tries": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256 FROM d""",
}
