import random

import pytest

from tablewright.llm import catalog, pairs, simhash
from tablewright.llm.components import components

from . import brute


def test_op8(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in catalog.op8_simhash_groups(spark, small).collect()}
    ids = sorted(rows)
    want = {r.doc_id: brute.fingerprint(r.text) for r in docs.collect()}
    assert {i: rows[i].fingerprint for i in ids} == {i: f"{want[i]:016x}" for i in ids}
    own = brute.groups(len(ids), lambda a, b: (want[ids[a]] ^ want[ids[b]]).bit_count() <= 2)
    assert [rows[i].component_id for i in ids] == [ids[g] for g in own]


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    group = {r.doc_id: r.component_id for r in rows}
    assert group[None] == group[1] == group[2] == 1 and group[3] == group[4] == 3
    assert [r.fp for r in rows if r.doc_id in (None, 1, 2)] == [0, 0, 0]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def values_near_one(random_bits, count, most):
    found = {random_bits}
    while len(found) < count:
        value = random_bits
        for b in random.sample(range(64), random.randint(1, most)):
            value ^= 1 << b
        found.add(value)
    return found


@pytest.mark.parametrize("tree, radius", [(1024, 2), (40, 2), (40, 3)])
def test_large_shards_lose_no_link(spark, monkeypatch, tree, radius):
    monkeypatch.setattr(simhash, "TREE", tree)
    random.seed(3)
    values = sorted(values_near_one(random.getrandbits(64), 500, 5) | {random.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    root = {r.vertex & simhash.ALL: r.root & simhash.ALL for r in components(simhash.links(df, radius)).collect()}
    want = brute.groups(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= radius)
    got = [root.get(v, v) for v in values]
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(0, len(values), 7) for b in range(len(values)))


def test_tree_finds_what_is_near():
    random.seed(8)
    values = list(values_near_one(random.getrandbits(64), 300, 6))
    for radius in (0, 2, 9):
        tree = simhash.Tree(radius)
        for v in values:
            assert sorted(tree.near(v)) == [i for i, x in enumerate(tree.values) if (x ^ v).bit_count() <= radius]
            tree.add(v)


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(900, 1000)] + [(i, i + 1) for i in range(2000, 2100)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def edited(spark, docs, count):
    random.seed(4)
    base = docs.where("doc_id = 3").first()
    rows = []
    for k in range(count):
        words = base.text.split(" ")
        for _ in range(random.randint(0, 2)):
            words[random.randrange(len(words))] = f"x{random.randrange(50)}"
        rows.append((100_000 + k, " ".join(words), "en", "s", 1))
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


@pytest.mark.parametrize("tile", [64, 3])
def test_deduplicate_keeps_one_of_each_group(spark, docs, odd, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    every = edited(spark, docs, 150).unionByName(odd.select(docs.columns))
    rows = sorted(every.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [brute.shingle_set(r.text) for r in rows]
    group = brute.groups(len(rows), lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and brute.jaccard(sets[a], sets[b]) >= 0.8)
    kept = simhash.deduplicate(every)
    assert kept.columns == every.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[g].doc_id for g in set(group))


def test_dissimilar_texts_in_one_shard_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash, "text_marks", lambda text, words, own=simhash.text_marks: one_shard(own(text, words)))
    random.seed(9)
    texts = [" ".join(f"w{random.randrange(5000)}" for _ in range(60)) for _ in range(60)]
    texts += [t + " end" for t in texts[:5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(60))


def one_shard(marks):
    from pyspark.sql import functions as F

    return F.struct(marks["fp"].alias("fp"), marks["content"].alias("content"), F.array(F.lit(1).cast("long")).alias("shards"))


@pytest.mark.parametrize("tile", [64, 3])
def test_deduplicate_follows_links_through_dropped_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(simhash, "text_marks", lambda text, words, own=simhash.text_marks: one_shard(own(text, words)))
    random.seed(12)
    word = lambda: f"w{random.randrange(100_000)}"
    stream, hub = [word() for _ in range(160)], [word() for _ in range(100)]
    texts = [stream[10 * k : 10 * k + 100] for k in range(6)]  # each is similar to the next one only
    for k in range(6):  # edited copies, each similar to the hub only; the hub comes second
        copy = list(hub)
        copy[12 * k + 10], copy[12 * k + 17] = word(), word()
        texts += [copy] if k else [copy, hub]
    texts += [[word() for _ in range(100)] for _ in range(20)]
    texts = [" ".join(t) for t in texts]
    sets = [brute.shingle_set(t) for t in texts]
    similar = [(a, b) for b in range(13) for a in range(b) if brute.jaccard(sets[a], sets[b]) >= 0.8]
    assert similar == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 7), *((7, k) for k in range(8, 13))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 6, *range(13, 33)]


def test_deduplicate_counts_repeated_lines_once(spark):
    random.seed(14)
    texts = []
    for _ in range(8):
        words, line = ([f"w{random.randrange(100_000)}" for _ in range(n)] for n in (5000, 8))
        texts += [" ".join(words) + "\n" + "\n".join([" ".join(line)] * times) for times in (1, 90)]
    for a, b in zip(texts[::2], texts[1::2]):
        assert brute.jaccard(brute.shingle_set(a), brute.shingle_set(b)) > 0.99
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(0, 16, 2))


def pairs_at_the_threshold(count):
    random.seed(21)
    streams = ([f"w{random.randrange(10_000_000)}" for _ in range(104)] for _ in range(count))
    return [" ".join(x) for s in streams for x in (s[:94], s[10:])]  # 80 of 100 shingles are in both


def test_deduplicate_finds_pairs_at_the_threshold(spark):
    texts = pairs_at_the_threshold(1000)
    assert {brute.jaccard(brute.shingle_set(a), brute.shingle_set(b)) for a, b in zip(texts[::2], texts[1::2])} == {0.8}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == list(range(0, 2000, 2))


def test_deduplicate_with_much_in_common(spark):
    """Texts of one notice and words of their own, below the least similarity: no rare shingle brings two together."""
    random.seed(22)
    word = lambda: f"w{random.randrange(100_000)}"
    shared = [word() for _ in range(200)]
    texts = [" ".join(shared + [word() for _ in range(80)]) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert simhash.deduplicate(docs).count() == 400
    members = spark.createDataFrame([(i, i, sorted(hash(x) for x in brute.shingle_set(t))) for i, t in enumerate(texts)], "vertex long, root long, shingles array<long>")
    assert pairs.prefix_pairs(pairs.prefixes(members, (4, 5)), members.select("vertex", "root"), (4, 5)).count() == 0
