"""Tokens of two tokenizers over one text: groups between common ends, links, and how often each pair of ids is linked.

Every id of A has at most one id of B with the same bytes. Most links are such a pair standing alone, and these are counted
in a vector as long as A's vocabulary. Only the other pairs are shuffled: to be counted, and to be met again by the
documents that hold them. Pairs in so many documents that one key would be hot are few, by the sum of all counts, and
are looked up in the tasks as the vector is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .bpe import byte_characters
from .texts import on_texts, raw, ready, strings

KNOWN_BYTES = 48 << 20  # of units and their links that a worker remembers, then it starts anew; no result depends on it
FREQUENT = 50_000  # pairs that are looked up in the tasks, at most
COLUMNS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string",
    "same": "array<int>", "same_links": "array<int>", "pairs": "array<long>", "pair_links": "array<int>",
}


def tokenizer_a(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer


def tokenizer_b(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def bytes_of_a(tokenizer) -> list[bytes]:
    """Bytes of each id of the byte-level vocabulary; one with a character outside its table has none."""
    back, table = {c: b for b, c in enumerate(byte_characters())}, [b""] * tokenizer.get_vocab_size()
    for token, number in tokenizer.get_vocab().items():
        if all(c in back for c in token):
            table[number] = bytes(back[c] for c in token)
    return table


def bytes_of_b(processor) -> list[bytes]:
    return [
        bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode()
        for i in range(processor.get_piece_size())
    ]


@lru_cache(2)
def same_bytes(path_a: str, path_b: str) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1. B may have two, a byte and a piece; the piece is taken."""
    a, processor = bytes_of_a(tokenizer_a(path_a)), tokenizer_b(path_b)
    b = bytes_of_b(processor)
    usable = [i for i in range(len(b)) if not processor.is_control(i) and not processor.is_unknown(i)]
    numbers = {b[i]: i for i in sorted(usable, key=lambda i: (not processor.is_byte(i), -i))}
    return np.array([numbers.get(x, -1) if x else -1 for x in a], np.int64)


def may_cut_before_spaces(processor) -> bool:
    """Whether no piece has a space after another character, so that words never share a token."""
    return not any("▁" in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size()))


def unit_bounds(data: np.ndarray, bounds: np.ndarray, cut_words: bool) -> np.ndarray:
    """Byte places of the texts and, inside them, before the spaces of a word; neither tokenizer has a token over such a place.

    The byte before is a printable one of ASCII or part of a character that surely is no blank, and a word follows.
    """
    cut = np.zeros(len(data) + 1, bool)
    if cut_words and len(data) > 2:
        space = data == 0x20
        begin = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        left, far = data[begin - 1], data[np.maximum(begin - 2, 0)]
        # Last two bytes of the blanks beyond ASCII; a few other characters are kept together with them.
        blank = (far == 0xC2) & np.isin(left, (0x85, 0xA0)) | (far == 0x9A) & (left == 0x80) | (far == 0x81) & (left == 0x9F)
        blank |= (far == 0x80) & ((left <= 0x8A) | np.isin(left, (0xA8, 0xA9, 0xAF)))
        begin = begin[(left > 0x20) & (left < 0x7F) | (left >= 0x80) & ~blank]
        filled = np.flatnonzero(~space)  # spaces that end a text go with its last word
        following = np.append(filled, len(data))[np.searchsorted(filled, begin)]
        cut[begin[following < bounds[np.searchsorted(bounds, begin, "right")]]] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the n + 1 bounds of the lists."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return np.fromiter((i for x in lists for i in x), np.int64, bounds[-1]), bounds


def chosen(values: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists with ``keep`` set; the others become empty."""
    many = np.diff(bounds)
    return values[np.repeat(keep, many)], np.concatenate([[0], np.cumsum(np.where(keep, many, 0))])


def joined(values: pa.Array, bounds: np.ndarray, by: str) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), values.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(by, pa.large_string()))


class Aligner:
    """Aligns slices of texts; remembers the alignment of every unit seen."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = tokenizer_a(path_a), tokenizer_b(path_b)
        self.cut_words = may_cut_before_spaces(self.b)
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (bytes_of_a(self.a), bytes_of_b(self.b)))
        self.sizes_a, self.sizes_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        self.same = same_bytes(path_a, path_b)
        self.forget()

    def forget(self) -> None:
        self.known, self.groups = pa.array([], pa.string()), pa.array([], pa.string())
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes agree
        self.bounds, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def size(self) -> int:
        return self.known.nbytes + self.groups.nbytes + self.numbers.nbytes + self.pairs.nbytes + self.links.nbytes

    def ids_of_a(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A space and letters go to the library's model as its pattern would leave them; others take all steps."""
        plain = pc.match_substring_regex(units, "^ [A-Za-z]+$").to_numpy(zero_copy_only=False)
        space, tokenize, texts = byte_characters()[0x20], self.a.model.tokenize, units.to_pylist()
        others = iter(self.a.encode_batch([x for x, p in zip(texts, plain) if not p], add_special_tokens=False))
        return flat([[t.id for t in tokenize(space + x[1:])] if p else next(others).ids for x, p in zip(texts, plain)])

    def learn(self, units: pa.Array) -> None:
        data, at = raw(units)
        size, n = np.diff(at), len(units)
        a, of_a = self.ids_of_a(units)
        b, of_b = flat(self.b.encode([x[1:] for x in units.to_pylist()], num_threads=1))
        good = np.ones(n, bool)
        for ids, bounds, sizes in ((a, of_a, self.sizes_a), (b, of_b, self.sizes_b)):
            total = np.concatenate([[0], np.cumsum(sizes[ids])])
            good &= total[bounds[1:]] - total[bounds[:-1]] == size
        whole, start = data[np.repeat(good, size)], np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
        same = np.ones(len(whole), bool)
        for ids, bounds, table in ((a, of_a, self.bytes_a), (b, of_b, self.bytes_b)):
            same &= raw(table.take(pa.array(chosen(ids, bounds, good)[0])))[0] == whole
        good[np.searchsorted(start, np.flatnonzero(~same), "right") - 1] = False  # bytes differ
        (a, of_a), (b, of_b) = chosen(a, of_a, good), chosen(b, of_b, good)
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])  # over all units: each is as long on both sides
        # A token meets those of B from the first that ends after its start to the last that starts before its end.
        first, last = np.searchsorted(end_b, end_a - self.sizes_a[a], "right"), np.searchsorted(end_b - self.sizes_b[b], end_a, "left")
        many = last - first
        ends = np.concatenate([[0], np.cumsum(many)])
        partner = np.arange(ends[-1]) + np.repeat(first - ends[:-1], many)
        code = np.repeat(a, many) << 32 | b[partner]
        unit = np.repeat(np.repeat(np.arange(n), np.diff(of_a)), many)
        order = np.lexsort((code, unit))
        code, owner = code[order], unit[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        tally = np.diff(np.append(begin, len(code)))
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = (np.concatenate([[0], np.searchsorted(x, cuts) + 1]) for x in (end_a, end_b))
        groups = pc.binary_join_element_wise(joined(pa.array(a), to_a, ","), joined(pa.array(b), to_b, ","), pa.scalar("|", pa.large_string()))
        of_group = np.searchsorted(to_a, of_a)
        links = np.bincount(unit, minlength=n)
        self.known = pa.concat_arrays([self.known, units])
        self.groups = pa.concat_arrays([self.groups, joined(groups, of_group, ";").cast(pa.string())])
        self.numbers = np.concatenate([self.numbers, np.stack([np.diff(of_a), np.diff(of_b), np.diff(of_group), links, good], 1)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.bincount(owner[begin], minlength=n))])
        self.pairs = np.concatenate([self.pairs, code[begin]])
        self.links = np.concatenate([self.links, tally])

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, a space before each text, and the texts' n + 1 bounds. An empty text has none."""
        data, bounds = raw(texts)
        full = np.diff(bounds) > 0
        data, bounds = np.insert(data, bounds[:-1][full], 0x20), bounds + np.concatenate([[0], np.cumsum(full)])
        cuts = unit_bounds(data, bounds, self.cut_words)
        units = strings(data, cuts, pa.string()).dictionary_encode()
        if self.size() > KNOWN_BYTES:
            self.forget()
        place = pc.index_in(units.dictionary, value_set=self.known)
        if place.null_count:
            self.learn(units.dictionary.filter(pc.is_null(place)))
            place = pc.index_in(units.dictionary, value_set=self.known)
        number = place.to_numpy(zero_copy_only=False)[units.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        return number, np.searchsorted(cuts, bounds)

    def align(self, texts: pa.Array) -> pa.Array:
        number, bounds = self.units(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        good = np.ones(len(texts), bool)
        good[text[self.numbers[number, 4] == 0]] = False  # one unit that differs takes the whole text out
        totals = np.zeros((len(texts), 4), np.int64)
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[number, :4], axis=0)])
        totals[good] = (running[bounds[1:]] - running[bounds[:-1]])[good]
        listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.groups.take(pa.array(number)))
        joined = pc.binary_join(listed.cast(pa.list_(pa.large_string())), pa.scalar(";", pa.large_string()))
        digests = ["" if not n else hashlib.sha256(x.as_buffer()).hexdigest() for x, n in zip(joined, totals[:, 0].tolist())]
        same, others = self.pairs_of(text, number, good)
        fields = [*(pa.array(totals[:, k]) for k in range(4)), pa.array(digests, pa.string())]
        for owner, code, links, is_same in ((*same, True), (*others, False)):
            at = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            fields += [pa.ListArray.from_arrays(at, pa.array((code >> 32).astype(np.int32) if is_same else code)), pa.ListArray.from_arrays(at, pa.array(links.astype(np.int32)))]
        return pa.StructArray.from_arrays(fields, list(COLUMNS))

    def pairs_of(self, text: np.ndarray, number: np.ndarray, good: np.ndarray):
        """Distinct pairs of each text with their links, apart those of equal bytes and the others."""
        use = good[text]
        units, times = np.unique(text[use] * len(self.numbers) + number[use], return_counts=True)
        owner, unit = np.divmod(units, max(len(self.numbers), 1))
        many = self.bounds[unit + 1] - self.bounds[unit]
        ends = np.cumsum(many)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[unit] - ends + many, many)
        owner, code, links = np.repeat(owner, many), self.pairs[source], self.links[source] * np.repeat(times, many)
        order = np.lexsort((code, owner))
        owner, code, links = owner[order], code[order], links[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        owner, code, links = owner[first], code[first], np.add.reduceat(links, first) if len(first) else links
        is_same = self.same[code >> 32] == (code & 0xFFFFFFFF)
        return tuple((owner[x], code[x], links[x]) for x in (is_same, ~is_same))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Add the alignment of each whole ``text`` by two tokenizers to the rows of ``docs``.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a piece model; both read a space and the text, special strings
    being plain text. Columns: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` (digest of the groups'
    ids), ``same`` (ids of A linked with the id of the same bytes) and ``pairs`` (other linked pairs, A's id in the
    upper 32 bits), each once with its number of links in ``same_links`` and ``pair_links``. A null or empty text, and one
    whose tokens do not spell it, has no tokens: zeros, an empty digest, empty lists. Columns of these names are
    replaced, all others are kept; repeated rows are treated alike.
    """
    ready(docs.sparkSession)

    def work():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Aligner(path_a, path_b).align

    kind = f"struct<{', '.join(f'{c} {t}' for c, t in COLUMNS.items())}>"
    made = docs.withColumn("__aligned", on_texts(work, kind)(F.col("text")))
    return made.select(*(c for c in docs.columns if c not in COLUMNS), "__aligned.*")


def vector_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: documents that link an id of A with the id of its bytes, as the negative of that id less one, or any other pair.

    A task adds the first into one vector, and sends the others counted by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(0, np.int64)
        for batch in batches:
            same, pairs = (x.flatten().to_numpy(zero_copy_only=False) for x in batch.columns)
            own = np.bincount(same, minlength=len(vector))
            own[: len(vector)] += vector
            vector = own
            code, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - ids.astype(np.int64)), pa.array(vector[ids])], ["pair", "n"])

    counted = aligned.select("same", "pairs").mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to aligned rows: links whose pair is in as many documents as any of its A id, and the sum of the counts.

    Counts are over all rows of ``aligned``. What is held by every task is as long as A's vocabulary or has at most
    ``FREQUENT`` pairs; of any other pair less than a ``FREQUENT``-th of all pairs' rows meet in the shuffle.
    """
    rows = stage(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counted = stage(vector_counts(rows), "pair-counts")
    spark, size = rows.sparkSession, len(same_bytes(path_a, path_b))
    same_count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    of_a = F.when(F.col("pair") < 0, -1 - F.col("pair")).otherwise(F.shiftright("pair", 32)).cast("int")
    own = F.max(F.when(F.col("pair") < 0, F.col("n")))
    for r in counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("best"), own.alias("same")).toLocalIterator():  # a row per id of A
        best[r.a], same_count[r.a] = r.best, r.same or 0
    others = counted.where("pair >= 0")
    total = others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = total // FREQUENT + 1  # so FREQUENT pairs at most have more
    top = others.where(F.col("n") >= least).orderBy("pair").toPandas()
    top_pair, top_count = top.pair.to_numpy(np.int64), top.n.to_numpy(np.int64)
    held = spark.sparkContext.broadcast((best, same_count, top_pair, top_count))

    def run(same: pa.Array, same_links: pa.Array, pairs: pa.Array, pair_links: pa.Array) -> pa.Array:
        best, same_count, top_pair, top_count = held.value
        n = len(same)
        n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)

        def add(owner, count, links, a):
            np.add.at(total, owner, count * links)
            np.add.at(n_best, owner, links * (count == best[a]))

        numbers = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owners = lambda x: np.repeat(np.arange(n), pc.list_value_length(x).to_numpy(zero_copy_only=False))
        a = numbers(same)
        add(owners(same), same_count[a], numbers(same_links), a)
        code, links, owner = numbers(pairs), numbers(pair_links), owners(pairs)
        at = np.minimum(np.searchsorted(top_pair, code), max(len(top_pair) - 1, 0))
        frequent = top_pair[at] == code if len(top_pair) else np.zeros(len(code), bool)
        add(owner[frequent], top_count[at[frequent]] if frequent.any() else np.zeros(0, np.int64), links[frequent], code[frequent] >> 32)
        bounds = pa.array(np.searchsorted(owner[~frequent], np.arange(n + 1)).astype(np.int32))
        kept = pa.StructArray.from_arrays([pa.array(code[~frequent]), pa.array(links[~frequent])], ["pair", "links"])
        return pa.StructArray.from_arrays([pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(bounds, kept)], ["n_best", "total", "rest"])

    run.__annotations__ = {"same": pa.Array, "same_links": pa.Array, "pairs": pa.Array, "pair_links": pa.Array, "return": pa.Array}
    looked_up = F.arrow_udf(run, "struct<n_best long, total long, rest array<struct<pair long, links long>>>")
    told = stage(rows.select("__row", looked_up("same", "same_links", "pairs", "pair_links").alias("s")).select("__row", "s.*"), "frequent-pairs")
    tops = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("best"))
    rare = others.where(F.col("n") < least).withColumn("a", of_a).join(F.broadcast(tops), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    shuffled = told.select("__row", F.inline("rest")).join(rare, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more")
    )
    summed = told.select("__row", "n_best", "total").join(shuffled, "__row", "left").select(
        "__row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum")
    )
    return rows.drop("n_best", "count_sum").join(summed, "__row").drop("__row")
