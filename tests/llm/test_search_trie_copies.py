"""Search by bags, conversation trie and owner tries against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from lociq.llm import bag_search, conversation_trie, owner_trie

LAST = (1 << 63) - 1


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        found = []
        for i, bag, n in bags:
            m = 25 + 75 * n * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                found.append((-score, LAST if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["the", "Of", "Éa", "x1", "tion", "rare" + str(rng.randrange(40))]) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 30))) for i in range(120)]
    docs += [(i, docs[i % 7][1]) for i in range(200, 260)]  # classes with many members
    docs += [(300, None), (301, ""), (302, " .;\n"), (303, "the " * 50_000), (None, docs[3][1]), (None, "x1 tion"), (5, docs[3][1]), (5, docs[3][1])]
    items = [(i, say(12)) for i in range(20)] + [(3, "the the the rare1"), (None, "Of x1"), (40, None), (41, "?!"), (42, "unheard")]
    return docs, items


@pytest.mark.parametrize("block, k", [(2 << 20, 10), (300, 3)])
def test_ranked_search(spark, corpus, monkeypatch, block, k):
    monkeypatch.setattr(bag_search, "ITEM_BYTES", block)
    monkeypatch.setattr(bag_search, "MEETINGS", 500)
    docs, items = corpus
    table = spark.createDataFrame([(i, t, 1, "a", 2, "c") for i, t in docs], "doc_id long, text string, n long, bag string, item_id int, cls string").repartition(5)
    asked = spark.createDataFrame([(i, t, 7, "z") for i, t in items], "item_id long, text string, doc_id long, row string")
    got = bag_search.ranked_search(table, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_ranked_search_with_the_chosen_bags_too_large_to_send(spark, corpus, monkeypatch):
    monkeypatch.setattr(bag_search, "BROADCAST_BYTES", 0)
    docs, items = corpus
    got = bag_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 10)


def test_ranked_search_of_nothing(spark, corpus):
    docs, items = (spark.createDataFrame(x, f"{n}_id long, text string") for x, n in zip(corpus, ("doc", "item"), strict=True))
    assert bag_search.ranked_search(docs.limit(0), items).count() == 0
    assert bag_search.ranked_search(docs, items.limit(0)).count() == 0
    assert bag_search.ranked_search(docs.where("text IS NULL"), items).count() == 0


def plain_trie(rows, shared=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}".encode()
            own[c].append((turn is not None, turn or 0, hashlib.sha256(key).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + own[c][h:] if shared else own[c]
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in ids if len(made[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        parent = members[path[:-1]][0] if path else None
        out.append((ids[0], len(path), parent, len(ids), kids[path], sum(not kids[p] for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [20_000, 40])
def test_conversation_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "Éb", "", None, "😀c"])) for c in [*range(0, 60), *range(100, 130), 205] for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(12)]  # one conversation many times
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "nobody"), (400, 0, "user", "x" * 300_000), (450, 1, "user", "alone")]
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, position long, key string, shard int").repartition(3)
    turns = conversation_trie.turns_in_order(table)
    got = conversation_trie.prefix_nodes(conversation_trie.with_shared_heads(turns)).drop("path")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_deep_and_empty_tries(spark):
    rows = [(c, t, "user", "same" if c else f"turn {t}") for c in (0, 1, 2) for t in range(2_000)]
    turns = conversation_trie.turns_in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    marks = turns.selectExpr("conv", "0L AS position", "cast(null AS binary) AS key", "0L AS chars").distinct()
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_nodes(turns.unionByName(marks)).collect()}
    assert len(got) == 4_001 and got[0, 0].n_leaves == 2 and got[1, 1].n_convs == 2 and got[1, 1].saved_tokens == 2_000 * 4
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_nodes(conversation_trie.with_shared_heads(conversation_trie.turns_in_order(nothing))).count() == 0


def test_tries_hold_all_strings():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(400)]
    trie = owner_trie.Trie()
    for k, t in enumerate(texts):
        node = trie.node(t)
        node.held = [*(node.held or []), k]
    weight = trie.bytes
    some = list(trie.spill(weight // 2))
    found = some + list(trie.spill(-1))
    assert 0 < len(some) < len(found) and trie.bytes == 0 and not trie.root.kids
    assert sorted(found) == sorted((t, [k for k, u in enumerate(texts) if u == t]) for t in set(texts))


@pytest.mark.parametrize("limit, keep", [(24 << 20, "largest"), (2_000, "largest"), (0, "smallest")])
def test_exact_copies(spark, monkeypatch, limit, keep):
    monkeypatch.setattr(owner_trie, "LIMIT", limit)
    rng = random.Random(4)
    texts = ["Ab é", "aB é", "ab É", None, "", " ", "x" * 400_000, "X" * 400_000, "x" * 399_999]
    rows = [(i, rng.choice(texts) if i % 3 else "the common one") for i in range(600)] + [(i, f"Prefix {i}") for i in range(600, 700)]
    rows += [(3, "twice"), (3, "TWICE"), (None, "lost"), (None, "LOST"), (None, "prefix 650")]
    table = spark.createDataFrame([(*r, "a", 1, "o") for r in rows], "doc_id long, text string, digest string, record long, owner string").repartition(7)
    got = owner_trie.exact_copies(table, keep=keep).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256("".join(c.lower() if c.isascii() else c for c in t or "").encode()).digest()].append(i)
    best = {d: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for d, ids in groups.items()}
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == collections.Counter((i, best[d], len(ids), d) for d, ids in groups.items() for i in ids)
    assert collections.Counter((bytes(r.digest), r.doc_id) for r in got if r.kept) == collections.Counter({(d, i): 1 for d, i in best.items()})


def test_no_copies_in_nothing(spark):
    assert owner_trie.exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
