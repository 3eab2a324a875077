import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import catalog, minhash, pairs, skew

from . import brute


def groups_of(rows, least=85):
    """Rows with doc_id and text -> doc_id: size of the set, smallest id of its group."""
    rows = sorted(rows)
    sets = [brute.shingle_set(t) for _, t in rows]
    near = lambda a, b: sets[a] and sets[b] and 100 * min(map(len, (sets[a], sets[b]))) >= least * max(map(len, (sets[a], sets[b])))
    linked = lambda a, b: near(a, b) and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    return {rows[i][0]: (len(sets[i]), rows[g][0]) for i, g in enumerate(brute.groups(len(rows), linked))}


def told(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op11(spark, small, docs):
    rows = catalog.op11_minhash_groups(spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups_of([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def words(n):
    return [f"w{random.randrange(1_000_000)}" for _ in range(n)]


def family(base, count, edits):
    """Copies of one text with changed words; their pairs lie on both sides of the least similarity."""
    for _ in range(count):
        copy = list(base)
        for _ in range(random.randrange(edits + 1)):
            copy[random.randrange(len(copy))] = f"x{random.randrange(1000)}"
        yield " ".join(copy)


def corpus():
    random.seed(31)
    stream, shared = words(300), words(200)
    texts = [" ".join(stream[4 * k : 4 * k + 60]) for k in range(40)]  # a chain: each is similar to the next one only
    texts += [t for _ in range(3) for t in family(words(200), 30, 6)]
    texts += [" ".join(shared + words(40)) for _ in range(60)]  # 0.68 to 0.72: much in common, no link
    texts += ["", "a", "a", "A", "one two three", "one two  three", None, " \n "]
    return list(enumerate(texts))


@pytest.mark.parametrize("tile, blocks", [(64, 16), (3, 2)])
def test_chains_families_and_boilerplate(spark, monkeypatch, tile, blocks):
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(skew, "BLOCKS", blocks)
    rows = corpus()
    assert told(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == groups_of(rows)


def test_what_one_leader_misses_is_found(spark, monkeypatch):
    """All classes in one bucket, so that one leader links few of them: the search by rare shingles finds the rest."""
    monkeypatch.setattr(minhash, "buckets", lambda keyed: keyed.select("vertex").distinct().select(
        F.lit(1).alias("key"), "vertex", F.lit(1000).alias("n"), F.lit(keyed.agg(F.min("vertex")).first()[0]).alias("leader")
    ))
    rows = corpus()
    assert told(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == groups_of(rows)


@pytest.mark.parametrize("least", [(85, 100), (4, 5), (1, 2)])
def test_prefix_pairs_lose_none(spark, least):
    rows = [(i, i, sorted(hash(x) & 0xFFFFFFFF for x in brute.shingle_set(t))) for i, t in corpus() if brute.shingle_set(t)]
    members = spark.createDataFrame(rows, "vertex long, root long, shingles array<long>")
    got = {(r.a, r.b) for r in pairs.prefix_pairs(pairs.prefixes(members, least), members.select("vertex", "root"), least).collect()}
    sets = {i: frozenset(s) for i, _, s in rows}
    want = {(a, b) for a in sets for b in sets if a < b and least[1] * len(sets[a] & sets[b]) >= least[0] * len(sets[a] | sets[b])}
    assert want <= got
    if least == (85, 100):  # what all of them share brings no two together
        assert not any(130 <= a < 190 or 130 <= b < 190 for a, b in got)


def test_altered_copies_do_not_meet_pair_by_pair(spark):
    """Copies similar to one text and not to one another are joined by it before pairs across components are listed."""
    random.seed(5)
    base = list(range(1000, 1100))
    rows = [(0, base)] + [(i, sorted(set(base) - set(random.sample(base, 8)) | {10_000 + 8 * i + j for j in range(8)})) for i in range(1, 151)]
    members = spark.createDataFrame(rows, "vertex long, shingles array<long>")
    sizes = []

    def confirm(tried):
        sizes.append(tried.count())
        return pairs.confirmed(tried, members, (85, 100))

    nothing = spark.createDataFrame([], "vertex long, root long")
    roots = pairs.through_prefixes(members, (85, 100), confirm, nothing).collect()
    assert {(r.vertex, r.root) for r in roots} == {(i, 0) for i, _ in rows}
    assert sizes[0] <= 2 * len(rows) and sizes[1] == 0


def test_signatures():
    random.seed(2)
    hashes = np.array([random.getrandbits(64) for _ in range(1200)], np.uint64)
    a, b = np.sort(hashes[:1000]), np.sort(hashes[200:])
    rows = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 180)
    assert abs((rows[0] == rows[1]).mean() - 800 / 1200) < 0.12
    factors, additions = minhash.functions(180)
    for k in (0, 179):
        values = [(int(x) * int(factors[k]) + int(additions[k])) % 2**64 >> 32 for x in a]
        assert int(rows[0, k]) & 0xFFFFFFFF == min(values)
    assert 110 < minhash.least_agreement(180, (85, 100)) < 135


def test_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].n_shingles == by_id[1].n_shingles == 0 and by_id[1].component_id == 1 and by_id[2].component_id == 2
    assert by_id[3].component_id == by_id[4].component_id == 3 and by_id[5].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0
    anonymous = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "A b  c"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(anonymous).collect()) == [(0, 0), (0, 7), (0, 7), (7, 7)]
