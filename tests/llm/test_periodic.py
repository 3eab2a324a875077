import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from tablewright.llm import catalog, periodic

from . import brute


def runs(words):
    """All runs by trying every period at every place."""
    n, rows = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                rows.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in rows.items())


def collapsed(words, found):
    gone = {i for start, q, length in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tail(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, words):
    found = runs(words)
    best = min(((-length, start, q) for start, q, length in found), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{start},{length},{q}\n" for start, q, length in found)
    return (doc_id, len(found), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, found))))


def test_op13(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 12_000}
    got = {r.doc_id: tuple(r) for r in catalog.op13_periodic_runs(spark, small).collect()}
    assert len(got) == len(docs)
    for i, text in short.items():
        assert got[i] == row(i, tail(i, brute.WORD.findall(text or "")))


def block(random_words, size):
    return [random.choice(random_words) for _ in range(size)]


def word_lists():
    random.seed(5)
    binary = [block("ab", random.randrange(20, 400)) for _ in range(6)]
    long = [block([f"w{i}" for i in range(500)], n) for n in (40, 100, 170)]
    repeated = [u * 3 + u[: len(u) // 2] for u in long] + [long[0] + long[1] * 2 + long[0]]
    mixed = [[w for _ in range(5) for w in (block("abc", random.randrange(1, 8)) * 40)[: random.randrange(1, 160)]] for _ in range(12)]
    touching = [["a"] * x + ["b"] + ["a"] * y + ["c"] for x, y in ((90, 120), (300, 1))]
    touching += [(["a", "b"] * 99)[:m] + (["a", "b"] * 99)[:n] for m, n in ((75, 80), (151, 90), (140, 171))]
    fibonacci, morse = [["a"], ["a", "b"]], [0]
    while len(fibonacci[-1]) < 500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(morse) < 256:
        morse += [1 - x for x in morse]
    return [*binary, *repeated, *mixed, *touching, fibonacci[-1], [str(x) for x in morse + morse + morse[:30]], ["x"] * 11, ["x"] * 12, []]


def test_runs_of_awkward_texts():
    lists = word_lists()
    found = periodic.runs_of_texts(pa.array([" ".join(x) for x in lists])).to_pylist()
    for words, r in zip(lists, found):
        want = runs(words)
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want) and r["n_words"] == len(words)


def test_hashes_that_agree_by_chance(monkeypatch):
    """With a hash of no value the words alone decide."""
    lists = word_lists()[:14]
    texts = pa.array([" ".join(x) for x in lists])
    want = periodic.runs_of_texts(texts).to_pylist()
    real = periodic.Words.agree
    monkeypatch.setattr(periodic.Words, "agree", lambda self, at, lag, length: real(self, at, lag, length) | (at % 7 == 0))
    assert periodic.runs_of_texts(texts).to_pylist() == want


@pytest.mark.parametrize("words, count", [(["word"] * 60_000, 1), ([f"w{i % 9_000}" for i in range(60_000)], 1), ([f"w{i}" for i in range(60_000)], 0)])
def test_long_texts(words, count):
    found = periodic.runs_of_texts(pa.array([" ".join(words)])).to_pylist()[0]
    assert len(found["runs"]) == count and found["n_words"] == 60_000
    assert len(found["collapsed"].split()) == len(set(words))


def test_odd_rows(spark, odd, none):
    rows = periodic.find(odd.withColumn("runs", odd.score)).collect()
    assert len(rows) == odd.count() and {"score", "ids", "lang"} <= set(rows[0].asDict())
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].runs == [] and by_id[i].collapsed == "" and by_id[i].n_words == 0 for i in (None, 1, 2))
    assert by_id[5].collapsed == "word" and by_id[6].runs[0].period == 4
    assert periodic.summary(periodic.find(periodic.with_tails(odd))).count() == odd.count()
    assert periodic.summary(periodic.find(none)).count() == 0
