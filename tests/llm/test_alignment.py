import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from tablewright.llm import alignment, catalog

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = alignment.tokenizer_a(PATHS[0]), alignment.tokenizer_b(PATHS[1])
    return a, b, alignment.bytes_of_a(a), alignment.bytes_of_b(b)


def ends(tokens):
    out = [0]
    for t in tokens:
        out.append(out[-1] + len(t))
    return out


def plain(text, libraries):
    """Whole text by both libraries: ids, groups and links, by comparing every token of a group with every other."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return 0, 0, 0, [], ""
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    own_a, own_b = [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
    if not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
        return 0, 0, 0, [], ""
    ends_a, ends_b = ends(own_a), ends(own_b)
    links, groups, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a[1:]) & set(ends_b[1:])):
        x, y = ends_a.index(cut), ends_b.index(cut)
        links += [(ids_a[p], ids_b[q]) for p in range(i, x) for q in range(j, y) if ends_a[p] < ends_b[q + 1] and ends_b[q] < ends_a[p + 1]]
        groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
        i, j = x, y
    return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def rows(texts, libraries):
    """The results of all texts by doc_id."""
    found = {i: plain(t, libraries) for i, t in texts.items()}
    count = Counter(pair for f in found.values() for pair in set(f[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    return {
        i: (n_a, n_b, n, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest)
        for i, (n_a, n_b, n, links, digest) in found.items()
    }


def told(df):
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return {r.doc_id: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 1, 40])
def test_op12(spark, small, libraries, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    texts = {r.doc_id: r.text for r in docs if len(r.text or "") < 20_000}
    if frequent == alignment.FREQUENT and len(texts) == len(docs):
        assert told(catalog.op12_token_alignment(spark, small)) == rows(texts, libraries)
    else:
        df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
        assert told(alignment.score(alignment.align(df, *PATHS), *PATHS)) == rows(texts, libraries)


AWKWARD = [
    "", " ", "   ", "foo ", " foo", "foo  bar", "a\n\n b", "x　 y z", "x  y", "x  y  z\t w ", "café bar", "▁ literal", "mid▁dle",
    "<s> </s> <|endoftext|> <unk> <0x41>", "日本語のテキスト です 🎉🎉 x", "é ́ x", "don't 's it's", "a" * 300, "0123456789 " * 20, "\x00 nul", "tab\there", "​ zero",
    "Ω≈ç√ ∫˜µ≤ ≥÷", "  \n  \n x", "\r\n\r\n", "ﬁ ﬃ ①", "…  …", "\u0085 next", "  ogham", "end  line", "    indented\n        code()",
]


def test_awkward_texts(spark, libraries):
    texts = dict(enumerate(AWKWARD + [x + " " + y for x, y in zip(AWKWARD, AWKWARD[5:])]))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got, want = told(alignment.score(alignment.align(df, *PATHS), *PATHS)), rows(texts, libraries)
    for i, text in texts.items():
        assert got[i] == want[i], text


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_BYTES", 4_000)
    aligner, texts = alignment.Aligner(*PATHS), [f"some words {i} and {i * 7919} more" for i in range(300)]
    want = alignment.Aligner(*PATHS).align(pa.array(texts)).to_pylist()
    assert [x for i in range(0, 300, 10) for x in aligner.align(pa.array(texts[i : i + 10])).to_pylist()] == want
    assert len(aligner.known) < 200


def test_same_bytes(libraries):
    _, _, bytes_a, bytes_b = libraries
    same = alignment.same_bytes(*PATHS)
    assert all(bytes_a[a] == bytes_b[b] for a, b in enumerate(same) if b >= 0) and (same >= 0).sum() > 5_000


def test_odd_rows(spark, odd, none):
    found = alignment.align(odd.withColumn("pairs", odd.score).withColumn("n_best", odd.ids), *PATHS)
    scored = alignment.score(found, *PATHS)
    assert scored.count() == odd.count() and {"score", "ids", "lang"} <= set(scored.columns) and len(set(scored.columns)) == len(scored.columns)
    by_id = {r.doc_id: r for r in scored.collect()}
    assert all(by_id[i][c] == 0 for i in (None, 1) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    assert by_id[1].groups_sha256 == "" and by_id[5].n_a >= 30_000
    assert alignment.score(alignment.align(none, *PATHS), *PATHS).count() == 0
