"""Byte-level BPE over Arrow batches: the tokenizers library, a table of bytes and characters, offsets, and the way back.

A text is cut where letters, digits, signs and blanks of ASCII meet, a last space before a word
going with the word. No token, no rule of the split pattern and no normalisation reaches over
such a place, so pieces can be encoded one by one, and each distinct piece once per worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .texts import on_texts, raw, ready, release, strings

KNOWN_BYTES, KNOWN_PIECES = 12 << 20, 800_000  # that a worker remembers, whichever comes first; then it starts anew, and no result depends on it
SLICE_BYTES = 1 << 20  # remembered pieces are looked up once a slice
LIBRARY_PIECES = 20_000  # pieces handed to the library at a time


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def spelled(token: bytes) -> str:
    table = byte_characters()
    return "".join(table[b] for b in token)


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a line has a token in base 64 and its number."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def rank_tokenizer(path: str, pattern: str):
    """Library tokenizer for a rank file. Any two tokens whose bytes join to a token may merge, in the order of its rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    merges = [
        (spelled(token[:i]), spelled(token[i:]))
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    tokenizer = Tokenizer(models.BPE(vocab={spelled(t): r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


def file_tokenizer(path: str):
    """Library tokenizer from its own file, special strings in texts handled as by default.

    Its pattern must be of the kind that splits words, digits, signs and blanks from one another.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


LETTER, DIGIT, SIGN, GAP = 1, 2, 3, 4
KINDS = np.zeros(256, np.uint8)  # bytes of an apostrophe, of control characters and beyond ASCII have none
KINDS[0x21:0x7F] = SIGN
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x27] = 0
KINDS[[0x20, *range(0x09, 0x0E)]] = GAP


def piece_bounds(data: np.ndarray, bounds: np.ndarray, inner: bool = True) -> np.ndarray:
    """Byte places at which pieces begin, the text bounds among them. ``inner``: also inside words, where letters, digits and signs meet."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        kind = KINDS[data]
        gap, full = kind == GAP, kind > 0
        full &= ~gap
        if inner:
            cut[1:-1] = full[:-1] & full[1:] & (kind[:-1] != kind[1:])
        begin = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        left, far = data[begin - 1], data[np.maximum(begin - 2, 0)]
        # Blanks beyond ASCII end in such bytes; a few other characters are kept together with them.
        known = full[begin - 1] | (left == 0x27) | (left >= 0x80) & ~np.isin(far, (0xC2, 0x80, 0x81, 0x9A))
        cut[begin[known]] = True  # before a run of blanks
        end = np.flatnonzero(gap[:-1] & ~gap[1:])  # the last of a run
        right = data[end + 1]
        known = full[end + 1] | (right == 0x27) | (right >= 0x80) & ~np.isin(right, (0xC2, 0xE1, 0xE2, 0xE3))
        end = end[known]
        spaced = data[end] == 0x20
        single = cut[end] & ~spaced  # one blank that is no space, after a character that surely is none
        cut[end[spaced & gap[np.maximum(end - 1, 0)]]] = True  # the last space of a run goes with the word after it
        cut[end[single] + 1] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


class Pieces:
    """Encodes slices of texts; keeps the ids of the pieces seen."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        spelled_ab = [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal(" ab"))]
        self.space = spelled_ab[0].removesuffix("ab")  # how the space before a word is spelled, if it is
        self.fold = normal("AB") == "ab"
        self.special = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, pieces: pa.Array) -> None:
        """Plain words go to the library's model, which its normaliser and its pattern would leave as they are; others take all steps."""
        plain = pc.match_substring_regex(pieces, "^ ?[a-z]+$" if self.fold else "^ ?[A-Za-z]+$")
        words, others = pieces.filter(plain), pieces.filter(pc.invert(plain))
        ids, lengths, tokenize = [self.ids], [], self.tokenizer.model.tokenize
        for texts, is_word in ((words, True), (others, False)):
            for start in range(0, len(texts), LIBRARY_PIECES):
                part = texts.slice(start, LIBRARY_PIECES)
                if is_word:
                    found = [[t.id for t in tokenize(x)] for x in pc.replace_substring(part, " ", self.space).to_pylist()]
                else:
                    found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in part.to_pylist()]
                lengths += map(len, found)
                ids.append(np.fromiter((i for x in found for i in x), np.int32))
        self.known = pa.concat_arrays([self.known, words, others])
        self.ids = np.concatenate(ids)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.array(lengths, np.int64))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 bounds of each text's ids."""
        data, bounds = raw(texts)
        whole = data.tobytes() if self.special else b""
        ordinary = not any(x in whole for x in self.special)
        cuts = piece_bounds(data, bounds, ordinary)
        if self.fold and ordinary:
            capital = (data >= 0x41) & (data <= 0x5A)
            capital[:-1] &= data[1:] < 0x80  # a mark after the letter may make another letter of it
            folded = data + (capital.view(np.uint8) << 5)
        pieces = strings(folded if self.fold and ordinary else data, cuts, pa.string()).dictionary_encode()
        distinct = pieces.dictionary
        if self.known.nbytes + self.ids.nbytes + self.bounds.nbytes > KNOWN_BYTES or len(self.known) + len(distinct) > KNOWN_PIECES:
            self.forget()
        place = pc.index_in(distinct, value_set=self.known)
        if place.null_count:
            self.learn(distinct.filter(pc.is_null(place)))
            place = pc.index_in(distinct, value_set=self.known)
        entry = place.to_numpy(zero_copy_only=False)[pieces.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        lengths = self.bounds[entry + 1] - self.bounds[entry]
        ends = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        source = np.repeat(self.bounds[entry] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[source], ends[np.searchsorted(cuts, bounds)]


def first_characters(texts: pa.Array, ids: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Character of its text that each id's first byte is part of. ``sizes``: bytes of every id; together they are the text."""
    data, text_bounds = raw(texts)
    number = np.zeros(len(data) + 1, np.int64)  # of characters that began before each byte
    np.cumsum((data & 0xC0) != 0x80, out=number[1:])
    begin = np.cumsum(sizes[ids]) - sizes[ids]  # ids of all texts cover all bytes in order
    return (number[begin + 1] - 1 - np.repeat(number[text_bounds[:-1]], np.diff(bounds))).astype(np.int32)


_WORKERS: dict[tuple, Pieces] = {}


def pieces_of(key: tuple, make: Callable) -> Pieces:
    """The worker's encoder for ``key``; kept for later tasks of the same worker."""
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Pieces(make())
    return _WORKERS[key]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def encoder(key: tuple, make: Callable, ending: int | None = None, most: int = SLICE_BYTES):
    """Column function text -> ids, each text's followed by ``ending`` if there is one."""

    def work():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        pieces = pieces_of(key, make)

        def one(texts: pa.Array) -> pa.Array:
            ids, bounds = pieces.encode(texts)
            if ending is not None:
                ids, bounds = np.insert(ids, bounds[1:], ending), bounds + np.arange(len(bounds))
            return lists(ids, bounds)

        return one

    return on_texts(work, "array<int>", most)


def offset_encoder(path: str, pattern: str):
    """Column function text -> struct<ids, offsets>."""

    def work():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = pieces_of(("ranks", path, pattern), lambda: rank_tokenizer(path, pattern))
        sizes = pc.binary_length(token_bytes(path)).to_numpy()

        def one(texts: pa.Array) -> pa.Array:
            ids, bounds = pieces.encode(texts)
            return pa.StructArray.from_arrays([lists(ids, bounds), lists(first_characters(texts, ids, bounds, sizes), bounds)], ["ids", "offsets"])

        return one

    return on_texts(work, "struct<ids array<int>, offsets array<int>>", SLICE_BYTES)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>) of the whole ``text`` by the ranks at ``path``, each match of ``pattern`` on its own.

    With ``offsets`` also ``offsets`` (array<int>): the character in the text that each id's first byte is part of.
    No special tokens; a string that looks like one is ordinary text. A null or empty text has no ids. Repeated rows
    are encoded alike; columns named ``ids`` or ``offsets`` are replaced, all others are kept.
    """
    ready(docs.sparkSession)
    if not offsets:
        return docs.withColumn("ids", encoder(("ranks", path, pattern), lambda: rank_tokenizer(path, pattern))(F.col("text")))
    return docs.withColumn("__bpe", offset_encoder(path, pattern)(F.col("text"))).withColumns({"ids": F.col("__bpe.ids"), "offsets": F.col("__bpe.offsets")}).drop("__bpe")


@lru_cache(4)
def token_bytes(path: str) -> pa.Array:
    """Bytes of each id, found by reversing the table of characters; ids without a token have none."""
    back = {c: b for b, c in enumerate(byte_characters())}
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(back[c] for c in spelled(token))
    return pa.array(table, pa.large_binary())


def bytes_of(path: str, ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids joined."""
    ids = ids.fill_null([]) if ids.null_count else ids
    bounds = ids.offsets.to_numpy().astype(np.int64)
    joined = token_bytes(path).take(ids.values.slice(bounds[0], bounds[-1] - bounds[0]))
    _, places, data = joined.buffers()
    places = np.frombuffer(places, np.int64)[: len(joined) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return strings(data, places[bounds - bounds[0]], pa.binary())


def integers_of(ids: pa.Array) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    ids = ids.fill_null([]) if ids.null_count else ids
    bounds = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False).astype("<u4")
    return strings(values.view(np.uint8), 4 * (bounds - bounds[0]), pa.binary())


def on_ids(work: Callable[[pa.Array], pa.Array], returns: str):
    """Column function of lists of ids."""

    def run(part: pa.Array) -> pa.Array:
        done = work(part)
        release()
        return done

    run.__annotations__ = {"part": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of ``ids`` joined.

    A character whose bytes lie in several tokens is whole again, because bytes are joined before anything reads them
    as characters; ``cast('string')`` gives the text. Null ids decode to no bytes; an id without a token is an error.
    """
    ready(tokens.sparkSession)
    return tokens.withColumn("decoded", on_ids(lambda ids: bytes_of(path, ids), "binary")(F.col("ids")))


def little_endian():
    """Column function array<int> -> the ids as little-endian unsigned 32-bit integers."""
    return on_ids(integers_of, "binary")


def digests(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the number of ids, and SHA-256 of the ids as little-endian integers and of the bytes they decode to."""

    def both(ids: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.list_value_length(ids).cast(pa.int64()), integers_of(ids), bytes_of(path, ids)], ["n", "ids", "bytes"])

    # One function of the ids, so that it runs where they are made and they are not sent in between.
    made = tokens.select("doc_id", on_ids(both, "struct<n long, ids binary, bytes binary>")(F.col("ids")).alias("made"))
    return made.select(
        "doc_id", F.col("made.n").alias("n_tokens"), F.sha2("made.ids", 256).alias("ids_sha256"), F.sha2("made.bytes", 256).alias("decoded_sha256")
    )
