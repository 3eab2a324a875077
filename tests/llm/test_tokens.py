import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe, catalog, counts, orc_tokens
from tablewright.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def awkward(count=6000):
    random.seed(5)
    letters = [
        "ab", " a", "a1 ", "The ion", "-= ", " \n\ta", "aeInst", "'srevltmd a", "é à'ñ 日", "a 　b \u0085", "T̈tİ ", "a.b,C1 !?",
        "\x00\x1f a\x7f", "<|endoftext|> ", "'re 've'll1!", "🎉é",
    ]
    texts = [None, "", "<|startoftext|>A b", "a <|endoftext|><|endoftext|>  ", "x" * 5000, " " * 3000 + "b", "'" * 50 + "s"]
    for _ in range(count):
        own = random.choice(letters)
        texts.append("".join(random.choice(own) for _ in range(random.randint(1, 60))))
    return texts


def every_character():
    return [f"a{c}b 1{c}1 !{c} {c}{c}'{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)][::7])]


@pytest.mark.parametrize("kind", ["ranks", "word", "byte"])
def test_pieces_are_the_whole_text(reference, kind):
    tokenizer = bpe.rank_tokenizer(RANKS, public_tokenizers.PATTERN) if kind == "ranks" else bpe.file_tokenizer(WORD_FILE if kind == "word" else BYTE_FILE)
    pieces, texts = bpe.Pieces(tokenizer), awkward() + every_character()[::20]
    want = [reference.encode_ordinary(t or "") if kind == "ranks" else tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for start in range(0, len(texts), 500):
        ids, bounds = pieces.encode(pa.array(texts[start : start + 500], pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == want[start : start + 500]


def test_remembered_pieces_do_not_matter(monkeypatch):
    tokenizer, texts = bpe.file_tokenizer(BYTE_FILE), pa.array(awkward(300), pa.string())
    whole = bpe.Pieces(tokenizer).encode(texts)[0]
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    forgetful = bpe.Pieces(tokenizer)
    parts = [forgetful.encode(texts.slice(i, 1))[0] for i in range(len(texts))]
    assert np.array_equal(whole, np.concatenate(parts))


def test_every_rank_decodes_to_its_bytes():
    ranks, table = bpe.read_ranks(RANKS), bpe.token_bytes(RANKS)
    assert all(table[r].as_py() == t for t, r in ranks.items())


def test_round_trip_and_offsets(docs, odd, reference):
    texts = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for row in bpe.decode(bpe.encode(texts, RANKS, public_tokenizers.PATTERN, offsets=True), RANKS).collect():
        ids = reference.encode_ordinary(row.text or "")
        assert row.ids == ids and bytes(row.decoded).decode() == (row.text or "")
        assert row.offsets == reference.decode_with_offsets(ids)[1]


def test_extra_columns_stay_or_are_replaced(odd, none):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == odd.columns and encoded.count() == odd.count() and encoded.where("score = 7").count() == 8
    assert bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_op2(spark, small, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in catalog.op2_byte_bpe(spark, small).collect():
        ids = reference.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_op6(spark, small):
    tokenizer, start = Tokenizer.from_file(WORD_FILE), 0
    got = {r.doc_id: r for r in catalog.op6_orc_tokens(spark, small).collect()}
    for row in sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()):
        ids = tokenizer.encode(row.text, add_special_tokens=False).ids + [1]
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens) == (start, len(ids))
        assert got[row.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_orc_odd_rows_and_pruning(spark, odd, none, docs):
    path = scratch_path(spark, "orc-test")
    orc_tokens.write_tokens(odd, path, WORD_FILE)
    rows = orc_tokens.with_starts(orc_tokens.read_tokens(spark, path)).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert [r.ids for r in rows][:3] == [[1], [1], [1]] and rows[3].ids == rows[4].ids
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    empty = scratch_path(spark, "orc-test")
    orc_tokens.write_tokens(none, empty, WORD_FILE)
    assert orc_tokens.with_starts(orc_tokens.read_tokens(spark, empty)).count() == 0
    many = scratch_path(spark, "orc-test")
    orc_tokens.write_tokens(docs, many, WORD_FILE)
    one = orc_tokens.read_tokens(spark, many).where("doc_id = 17")
    assert "EqualTo(doc_id,17)" in one._jdf.queryExecution().toString() and one.count() == 1
    files = sorted(r.m for r in orc_tokens.read_tokens(spark, many).groupBy(F.input_file_name()).agg(F.struct(F.min("doc_id"), F.max("doc_id")).alias("m")).collect())
    assert all(a[1] < b[0] for a, b in zip(files, files[1:]))


def test_counts_equal_the_library():
    words = counts.Words(BYTE_FILE)
    texts = awkward() + every_character()
    want = [len(x.ids) for x in Tokenizer.from_file(BYTE_FILE).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert counts.counter(words)(pa.array(texts, pa.string())).to_pylist() == want


def test_chunks_may_fall_anywhere(monkeypatch):
    words, texts = counts.Words(BYTE_FILE), pa.array(awkward(400), pa.string())
    want = counts.counter(words)(texts).to_pylist()
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(counts, "CHUNK", size)
        assert counts.counter(words)(texts).to_pylist() == want


def test_compiled_table_starts_anew(monkeypatch):
    words, texts = counts.Words(BYTE_FILE), awkward(300)
    want = [counts.counter(words)(pa.array([t], pa.string()))[0].as_py() for t in texts]
    monkeypatch.setattr(counts, "TRANSITIONS", 50)
    fresh = counts.Words(BYTE_FILE)
    assert [counts.counter(fresh)(pa.array([t], pa.string()))[0].as_py() for t in texts] == want


def test_op10(spark, small, odd, none):
    tokenizer = Tokenizer.from_file(BYTE_FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for row in catalog.op10_token_counts(spark, small).collect():
        n = len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 1024)
    assert [r.n_tokens for r in counts.measure(odd, BYTE_FILE).where("text is null or text = ''").collect()] == [0, 0]
    assert counts.measure(none, BYTE_FILE).count() == 0
