"""Pipeline operators against plain versions on small tables with nulls, empty and long texts, copies and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lociq.llm import chain, decision_list, html_diff, lattice, minhash, packing, radix, token_cache, warc, wu_manber
from lociq.llm.components import components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, key long, a string, id string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "Éa", "ranhe", "tion,", "thed", "über", "sh.\n", "er"]) + rng.choice(["", "x", "yz"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120).split()
    near = [" ".join(base[:k] + ["odd"] + base[k + 1 :]) for k in (5, 30, 60)]
    texts = [" ".join(base), *near, " ".join(base), None, "", " \t\n", "one", "two words", "日本 語 " * 20, prose(2, 4000), prose(3, 60) + " " + " ".join(base[20:80]), prose(4, 60), "<|endoftext|> Å H̱ <|x", "a" * 300]
    out = [(k + 10, t, k, "a", "x") for k, t in enumerate(texts)]
    return [*out, (10, texts[0], 0, "a", "x"), (None, texts[13], 1, "b", "y"), (None, None, 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def spaced(text):
    return (text or "").encode().lower().split()


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert found == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50}


@pytest.mark.parametrize("tile", [1000, 2])
def test_near_duplicates(docs, rows, empty, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    sets = {}
    for i, t, *_ in rows:
        w = spaced(t)
        if i is not None:
            sets[i] = frozenset([tuple(w)] if 0 < len(w) < 3 else (tuple(w[k : k + 3]) for k in range(len(w) - 2)))
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {(i, len(s), group[i]) for i, s in sets.items()}
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_a_wide_group_gives_few_links(spark):
    """Chains of edits: neighbours are linked, far ends are not, and no tile writes out its pairs."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(["new"] * k + words[k:]) for k in range(0, 40)]
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_the_rest_pass_finds_all_links(spark):
    """Pairs at 0.80 to 0.90 that only the rest pass can link: a first list told by low bytes loses some of them."""
    texts, want = [], set()
    for k in range(3000):
        own = 5 + k % 6
        shared = [f"p{k}x{j}" for j in range(100 - 2 * own)]
        texts += [(2 * k + side, " ".join(shared + [f"p{k}s{side}x{j}" for j in range(own)])) for side in (0, 1)]
        want.add((2 * k, 2 * k + 1))
    docs = spark.createDataFrame(texts, "id long, text string").repartition(8)
    signed = minhash.sign(docs, 1)
    members = signed.select(F.posexplode("keys").alias("at", "key"), "id", "n_shingles", *minhash._LANES, F.col("id").alias("label"))
    links = [tuple(sorted(map(int, r))) for r in minhash.rest_links(members, docs, 1, 80).collect()]
    assert len(links) == len(want) and set(links) == want


def test_pairs_of_a_large_tile_take_little_memory():
    """Two blocks of near copies in different groups: all their pairs have equal values, and a pair's keys take a kilobyte."""
    n, whole = 2 * 700, np.arange(64, dtype=np.int64)
    columns = {"tile": np.zeros(n, np.int64), "at": np.zeros(n, np.int32), "id": np.arange(n), "n_shingles": np.full(n, 10)}
    columns |= {c: np.zeros(n, np.int64) for c in minhash._LANES} | {"label": np.arange(n), "side": np.repeat(np.int32([-1, 1]), n // 2)}
    keys = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 64, np.tile(whole + 1, n))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns.values()), keys], names=[*columns, "keys"])
    tracemalloc.start()
    found = sum(b.num_rows for b in minhash._in_tiles(iter([batch]), percent=80, kept=None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 60_000_000


def test_pages_of_one_template_meet_in_few_lists(spark):
    """Pages that share 40 % of their words and are no duplicates: rows in tiles grow with the pages, and the links among them are found."""
    many = []
    for pages in (1000, 4000):
        texts = [(k, " ".join([f"t{j}" for j in range(40)] + [f"p{k}x{j}" for j in range(60)])) for k in range(pages)]
        texts += [(pages + k, t.replace("x59", "y59").replace("x58", "y58")) for k, t in texts[:: pages // 100]]
        docs = spark.createDataFrame(texts, "id long, text string").repartition(8)
        classes = minhash.sign(docs, 1)
        members = minhash.prefixes(classes, 85).join(classes.drop("keys"), "id").withColumn("label", F.col("id"))
        many.append(minhash._tiles(members).count())
        found = minhash.near_duplicates(docs, "id", "text", 1, 85).where("id <> component_id").collect()
        assert {(r.id, r.component_id) for r in found} == {(pages + k, k) for k in range(0, pages, pages // 100)}
    assert many[1] < 6 * many[0] + 1000


def test_a_large_group_meets_the_others_only(spark):
    """A group of 20,000 in one list with five others: each of its rows is in one tile, and none meets its own group."""
    rows = spark.range(20_005).selectExpr("0 as at", "7L as key", "id", "10L as n_shingles", *(f"0L as {c}" for c in minhash._LANES), "if(id < 20000, 0L, id) as label")
    found = minhash._tiles(rows).groupBy("side", (F.col("label") == 0).alias("main")).count().collect()
    assert {(r.side, r.main): r["count"] for r in found} == {(1, True): 20_000, (-1, False): 100, (0, False): 5}


def test_warc(spark, tmp_path):
    big = prose(5, 600_000)
    rows = [(1, "http://x/a b%20c", big, 9), (2, None, "", 9), (3, "u\r\nv", None, 9), (4, "http://y", big, 9), (None, "z", big, 9), (5, "ü", "WARC/1.0\r\n\r\nx\r\n\r\n", 9), (5, "ü", "WARC/1.0\r\n\r\nx\r\n\r\n", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk long")
    found = warc.archive_round_trip(pages).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((str(i), str(u), len((t or "").encode()), digest(t), str({3: 2, 4: 1}.get(i))) for i, u, t, _ in rows)
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, str(r.refers_to)) for r in found) == want
    assert all(r.verified and (r.record_type == "revisit") == (r.refers_to is not None) for r in found)
    manifest = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}")
    chunked = warc.read_archives(manifest).where("page_id = 1").orderBy("chunk").collect()
    assert len(chunked) > 2 and b"".join(bytes(c.payload) for c in chunked).decode() == big
    assert all(c.digest_so_far == base64.b32encode(hashlib.sha1(b"".join(bytes(x.payload) for x in chunked[: k + 1])).digest()).decode() for k, c in enumerate(chunked))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    import pyarrow as pa

    pieces = lattice.Pieces(PIECES)
    logs = np.concatenate([np.log(pieces.prior / pieces.prior.sum()), [-np.inf]])
    number = lambda b: int(pieces.find(lattice.span_hashes(lattice.prefix_sums(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)])))[0])

    def plain(b):
        ways = [1.0] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            ways[j] = sum(ways[i] * np.exp(logs[number(b[i:j])]) for i in range(j))
        return np.log10(ways[-1])

    words = ["the", "über", "日本", "x", "thanedble"]
    found = lattice.log_probabilities(pa.array([w.encode() for w in words], pa.binary()), pieces, logs)
    assert np.allclose(found, [plain(lattice.MARK + w.encode()) for w in words])


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_lattice_scores(docs, rows, empty, head):
    counts, ends, held = collections.Counter(), 0, lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, t, *_ in rows:
        if not held(i):
            counts.update(spaced(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    found = lattice.lattice_scores(docs, PIECES, head=head, rounds=1).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == sorted((str(i), held(i), len(spaced(t)) + 1, sum(counts[w] > 0 for w in spaced(t)) + 1, n, round(float(sum(base(counts[w]) for w in spaced(t)) + base(ends)), 6)) for i, t, *_ in rows)
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)
    assert lattice.lattice_scores(empty, PIECES, rounds=1).count() == 0


def test_token_counts(spark, docs, rows, empty, tmp_path):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    cache = f"{tmp_path}/cache"
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_cache.token_counts(docs, WORD_BPE, cache).collect()) == want
    # The second run found all counts: no digest is stored twice.
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_digest").distinct().count()
    assert token_cache.token_counts(empty, WORD_BPE, cache).count() == 0


def test_text_statistics(spark, rows, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [t for _, t, *_ in rows] + ["a b c d e a b c d e f", "x\nx\n\n \n x\nx", "#a *b| <c>$%&", "q " * 50]
    found = decision_list.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        t = texts[r.doc_id] or ""
        w, lines = word.findall(t), [x for x in t.split("\n") if word.search(x)]
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert tuple(r)[1:] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again), len(set(w)))
    assert decision_list.text_statistics(empty).count() == 0


def test_decision_list(spark, empty):
    texts = [(k, prose(k, 60) + (" #### $$ %% ** ||" * 20 if k % 3 == 0 else "")) for k in range(240)] + [(None, prose(7, 60)), (999, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(240)] + [(5, None), (None, 0)], "doc_id long, quality int")
    found = {r.doc_id: r.kept for r in decision_list.quality_verdicts(docs, labels).collect()}
    assert all(found[k] == (k % 3 != 0) for k in range(240)) and found[None] and not found[999]
    assert all(r.kept != r.base_failed for r in decision_list.quality_verdicts(docs, labels.limit(0)).collect())
    assert decision_list.quality_verdicts(empty, labels).count() == 0


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (rng.choices("abc", k=rng.randint(0, 9)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_diff.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[k] in rest for k in found)


def test_main_texts(spark):
    site = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div>Site line</div>"
    rows = [
        (1, "http://h/a/1", site + "<article><h1>One</h1><p>Tom &amp; <b>A</b>nna<p>more\n text<script>x<p>y</script></article><footer>f</footer>", 0),
        (2, "http://h/a/2", site + "<article><h1>One</h1><p>Tom &amp; <b>A</b>nna<p>more\n text</article><div class='comments'><p>c</p></div>", 0),
        (3, "http://h/b/1", site + "<div><p>Alone here</p><p>second</p><p>third</p></div><div id=cookie-notice>ok</div>", 0),
        (4, "http://h/b/2", site + "<div><p>Other text</p><p>fourth</p><p>fifth</p></div>", 0),
        (5, None, None, 0), (6, "not a url", "", 0), (None, "http://g/", "<p>x<form>y</form>z", 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {r.page_id: r.text for r in html_diff.main_texts(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == {1: "One Tom & Anna more text", 2: "One Tom & Anna more text", 3: "Alone here second third", 4: "Other text fourth fifth", 5: "", 6: "", None: "x z"}
    assert html_diff.main_texts(pages.limit(0)).count() == 0


def test_toxicity(spark, empty):
    texts = [(k, prose(k, 80) + (" vilexa gruntz vilezo" if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame([*texts, (None, "vilexa gruntz vilezu"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(0, 400) if k % 5] + [(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    found = chain.toxicity(docs, labels, {"toxic": "toxic = 1", "both": "toxic = 1 AND quality = 0"}).collect()
    assert len(found) == 403
    held = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert all((r.p_toxic >= 0.5) == (r.doc_id % 4 == 0) for r in held) and all(r.p_both < 0.5 for r in found)
    none = chain.toxicity(docs, labels.limit(0), {"toxic": "toxic = 1"}).collect()
    assert all(r.p_toxic < 0.5 for r in none)
    assert chain.toxicity(empty, labels, {"toxic": "toxic = 1"}).count() == 0


@pytest.mark.parametrize("limit", [wu_manber.PART_BYTES, 200])
def test_wu_manber(spark, docs, rows, empty, limit):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().lower())
    items = [(1, rows[0][1][100:400]), (2, prose(2, 30)), (3, "One"), (4, "two, WORDS"), (5, "--"), (6, None), (11, rows[0][1][100:400]), (None, "the")]
    strings = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            strings[tuple(w[k : k + n])].add(i)
    want = []
    for i, t, *_ in rows:
        w, hit, seen = words(t), set(), set()
        for n in {len(s) for s in strings}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in strings:
                    hit.update(range(k, k + n))
                    seen |= strings[tuple(w[k : k + n])]
        want.append((str(i), len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest(), 0 < len(hit) * 20 >= len(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = wu_manber.contamination(wu_manber.occurrences(docs, benchmark, limit=limit)).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in found) == sorted(want)
    assert wu_manber.occurrences(empty, benchmark).count() == 0
    assert {r.n_hit for r in wu_manber.contamination(wu_manber.occurrences(docs, benchmark.limit(0))).collect()} == {0}


@pytest.mark.parametrize("batch,hot", [(1 << 21, 512), (3000, 1)])
def test_repeated_spans(docs, rows, empty, monkeypatch, batch, hot):
    monkeypatch.setattr(radix, "BATCH_BYTES", batch)
    monkeypatch.setattr(radix, "PART_GRAMS", 300)
    monkeypatch.setattr(radix, "PART_RECORDS", 100)
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = {p for k in range(len(b) - 49) if i is not None and first[b[k : k + 50]] < i for p in range(k, k + 50)}
        want.append((str(i), len(b), len(gone), sum(p - 1 not in gone for p in gone), bytes(c for p, c in enumerate(b) if p not in gone)))
    monkeypatch.setattr(radix, "HOT_BATCHES", hot)
    found = radix.repeated_spans(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s["bytes"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in found) == sorted(want)
    assert radix.repeated_spans(empty).count() == 0
    left = {r.doc_id: r for r in radix.without_repeats(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert left[10].text == rows[0][1] and 14 not in left and left[15].text is None and left[16].text == "" and left[10].a == "a"


@pytest.mark.parametrize("block", [30_000, 6])
def test_packing(docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(i), k, a, min(256, len(ids) - a), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    packed = packing.pack(packing.pieces(docs, WORD_BPE, 256), 256)
    found = packed.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    if block > 6:
        assert len(ends) <= -(-sum(ends.values()) // 256) + 2
    by = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert by == ends
    assert packing.pack(packing.pieces(empty, WORD_BPE, 256), 256).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.count() <= docs.count(), name
        rows = after.collect()
        assert {r.doc_id for r in rows} <= before and all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert len(kept) > 0.6 * len(before)
    assert not radix.repeated_spans(docs).where(F.size("spans") > 0).where("n_bytes > 100000").count()


def test_stages_go_by_row(spark, tmp_path):
    """Both removing stages against brute force, with null and repeated ids."""
    base, other = prose(21, 200).split(), prose(22, 60)
    near, item = " ".join([*base[:50], "odd", *base[51:]]), prose(23, 40)
    rows = [(None, " ".join(base)), (7, near), (7, near), (7, other), (None, near), (3, " ".join(base)), (3, item), (None, item), (8, None), (None, None), (None, other), (9, "few words"), (9, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = []
    for _, t in rows:
        w = spaced(t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4))))
    group = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    want = [rows[min((k for k in range(len(rows)) if group[k] == g), key=key)] for g in set(group)]
    plain = lambda found: sorted(map(repr, map(tuple, found)))
    assert plain(corpus_pipeline.near_duplicates(spark, docs, "").collect()) == plain(want)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert plain(corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == plain(r for r in rows if r[1] != item)


def test_main_texts_at_any_partitions(spark):
    """Two lines of the site and four of the page, on hosts of a few pages: the same texts at 1, 8 and more partitions than rows."""
    rows = [(k, f"http://h{k // 6}/p/{k:03}", "<p>site</p>" + "".join(f"<p>own {k} {j}</p>" for j in range(4)) + "<p>foot</p>") for k in range(18)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    try:
        for n in ("1", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {r.page_id: r.text for r in html_diff.main_texts(pages).collect()} == {k: " ".join(f"own {k} {j}" for j in range(4)) for k in range(18)}, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_main_texts_do_not_depend_on_partitions(spark):
    """80 % boilerplate, copies and near copies without article elements, at 1, 8 and more partitions than rows."""
    page = lambda body: "".join(f"<p>site {k}</p>" for k in range(8)) + "".join(f"<p>{x}</p>" for x in body)
    bodies = [[f"own {k}", f"text {k}"] for k in range(12)]
    long = [f"line {k}" for k in range(30)]
    bodies += [long, long, [*long[:29], "edited"], long, ["after", "them"]]
    rows = [(k, f"http://h/p/{k:03}", page(b)) for k, b in enumerate(bodies)]
    rows += [(100 + k, f"http://g/{k}", "".join(f"<p>menu {j}</p>" for j in range(40)) + f"<p>only {k}</p>") for k in range(3)]
    want = {k: " ".join(b) for k, b in enumerate(bodies)} | {100 + k: f"only {k}" for k in range(3)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    try:
        for n in ("1", "8", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert {r.page_id: r.text for r in html_diff.main_texts(pages).collect()} == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><div class='article-header'><h1>Title</h1></div><p>x</p></article>", ["Title", "x"]),
        ("<article><h2 class='section-header'>Part</h2><h3 class='comments'>Word</h3><p id='related-work'>Work</p></article>", ["Part", "Word", "Work"]),
        ("<article><div class='ad'>buy</div><div class='big comments'>c</div><div class='share-bar'>s</div><form class=x>f</form><p>x</p></article>", ["x"]),
        ("<body><form id='page'><div>menu</div><article><p>x</p></article></form></body>", ["x"]),
        ("<body><form id='page'><nav>menu</nav><p>x</p><p>y</p></form></body>", ["x", "y"]),
        ("<p>x</p><form><p>y</p></form>", ["x"]),
        ("<form><aside><article>other</article></aside><article>x</article></form>", ["x"]),
        ("<div class='article-header'>h</div><p>x</p>", ["x"]),
    ],
)
def test_marked_names_inside_an_article(page, want):
    lines = html_diff.lines_of(page)
    article = any(x.inside for x in lines)
    assert [x.text for x in lines if x.inside or (x.inside is None and not article)] == want
