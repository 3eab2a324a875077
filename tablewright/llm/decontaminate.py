"""Benchmark decontamination: a BM25 index of test items, searched by every passage of every document.

Items are indexed in parts of at most ``PART`` words. A score is BM25 divided by the score the
part gives itself, so 1 means that the passage has all its words, and one threshold serves all
parts. Passages are ``2 * PART`` words at every ``PART`` words: what is up to ``PART`` words long
lies whole in one of them. Search is block-max WAND; retrieved items are verified against the text.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .texts import codes, on_texts, raw, ready, spans

K1, B = 1.2, 0.75
PART = 64
BLOCK = 16  # postings with a common maximum
COARSE = 48  # ranges of parts with common maxima for the first test of all passages
INDEX_PARTS = 10_000  # parts in one index; more items are searched index by index
THRESHOLD, QUESTION, ANSWER, GRAM = 0.6, 0.7, 0.5, 5
REMEMBERED = 20_000

# Capitals of ASCII and Latin-1: their small letters lie 32 above them.
CAPITALS = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
SMALL = "".join(chr(ord(c) + 32) for c in CAPITALS)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(WORD.encode())
IN_WORD = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def words(text: Column) -> Column:
    """Words of a text: digits, letters, and everything beyond ASCII, with the capitals of ASCII and Latin-1 made small."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """Postings of terms in ascending order of parts, their block maxima, and the items."""

    terms: list[str]
    bounds: np.ndarray  # of each term's postings
    parts: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # of each term
    block_bounds: np.ndarray  # of each term's blocks
    block_last: np.ndarray  # last part of a block
    block_most: np.ndarray
    coarse: np.ndarray  # by range of parts and term
    item_of: np.ndarray  # of each part
    items: list
    words: list[list[str]]
    answers: list[int]  # words at the end that are the answer


def item_parts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``item_id, words, answer`` of each item with words, and ``item_id, part, words`` of its parts.

    The answer is the last sentence; an item of one sentence has its last third of words for an answer.
    """
    last = F.regexp_extract(F.coalesce("text", F.lit("")), r"([^.?!\n]*)[.?!\s]*$", 1)
    told = items.dropDuplicates(["item_id", "text"]).select("item_id", words(F.col("text")).alias("words"), F.size(words(last)).alias("answer"))
    told = told.where(F.size("words") > 0).withColumn(
        "answer", F.when((F.col("answer") > 0) & (F.col("answer") < F.size("words")), F.col("answer")).otherwise(F.ceil(F.size("words") / 3)).cast("int")
    )
    told = stage(told.withColumn("number", F.monotonically_increasing_id()), "items")
    begin = F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PART)))
    parts = told.select("number", begin.alias("part"), "words").withColumn("words", F.slice("words", F.col("part") + 1, PART))
    return told, parts


def postings(parts: DataFrame) -> DataFrame:
    """``number, part, term, impact``: BM25 impacts with statistics over all parts, divided by the part's own score."""
    size = parts.agg(F.count("*"), F.avg(F.size("words"))).first()
    terms = parts.select("number", "part", F.size("words").alias("length"), F.explode("words").alias("term"))
    times = terms.groupBy("number", "part", "length", "term").agg(F.count("*").alias("tf"))
    frequent = times.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.log(1 + (size[0] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (size[1] or 1.0)))
    scored = times.join(frequent, "term").withColumn("impact", rarity * damped)
    own = scored.groupBy("number", "part").agg(F.sum("impact").alias("own"))
    return scored.join(own, ["number", "part"]).select("number", "part", "term", (F.col("impact") / F.col("own")).alias("impact"))


def build(rows: list, told: list) -> Index:
    """Index of the collected rows of at most ``INDEX_PARTS`` parts, and some more of the items that they end with."""
    length = Counter((r.number, r.part) for r in rows)
    names = sorted(length, key=lambda x: (length[x], x))  # neighbours of like length have like impacts: tight maxima
    part_of, terms = {x: i for i, x in enumerate(names)}, sorted({r.term for r in rows})
    term_of, item_of = {t: i for i, t in enumerate(terms)}, {r.number: i for i, r in enumerate(told)}
    term, part = np.array([term_of[r.term] for r in rows], np.int64), np.array([part_of[r.number, r.part] for r in rows], np.int64)
    impact = np.array([r.impact for r in rows])
    order = np.lexsort((part, term))
    term, part, impact = term[order], part[order], impact[order]
    bounds = np.searchsorted(term, np.arange(len(terms) + 1))
    starts = [np.arange(a, b, BLOCK) for a, b in zip(bounds, bounds[1:])]
    block = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    block_bounds = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int64)
    ends = np.minimum(block + BLOCK, np.repeat(bounds[1:], np.diff(block_bounds)))
    coarse = np.zeros((COARSE, len(terms)))
    np.maximum.at(coarse, (part * COARSE // max(1, len(names)), term), impact)
    return Index(
        terms, bounds, part, impact, np.maximum.reduceat(impact, bounds[:-1]) if len(terms) else impact, block_bounds, part[ends - 1] if len(block) else block,
        np.maximum.reduceat(impact, block) if len(block) else impact, coarse, np.array([item_of[n] for n, _ in names], np.int64),
        [r.item_id for r in told], [r.words for r in told], [r.answer for r in told],
    )


class Search:
    """Block-max WAND over an index."""

    def __init__(self, index: Index, threshold: float) -> None:
        self.index, self.threshold = index, threshold - 1e-9
        self.vocabulary = pa.array([t.encode() for t in index.terms], pa.large_binary())
        # Python lists: a search takes single numbers, which they give faster than arrays do.
        self.lists = [
            (index.parts[a:b].tolist(), index.impacts[a:b].tolist(), index.block_last[c:d].tolist(), index.block_most[c:d].tolist())
            for a, b, c, d in zip(index.bounds, index.bounds[1:], index.block_bounds, index.block_bounds[1:])
        ]
        self.most = index.most.tolist()
        self.seen: OrderedDict[bytes, list] = OrderedDict()

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Parts that score at least the threshold for a set of terms, with their scores."""
        key = terms.tobytes()
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.popitem(last=False)
            self.seen[key] = self.walk(terms.tolist())
        return self.seen[key]

    def walk(self, terms: list[int]) -> list[tuple[int, float]]:
        found, lists, most, threshold = [], self.lists, self.most, self.threshold
        cursors = [[lists[t][0][0], t, 0] for t in terms]  # part, term, place in the term's postings

        def move(cursor: list, least: int) -> bool:
            """To the first posting of ``least`` or more, block by block; whether there is one."""
            parts, _, last, _ = lists[cursor[1]]
            place, block = cursor[2], cursor[2] // BLOCK
            while block < len(last) and last[block] < least:
                block += 1
                place = block * BLOCK
            if block == len(last):
                return False
            while parts[place] < least:
                place += 1
            cursor[0], cursor[2] = parts[place], place
            return True

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                bound += most[cursor[1]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            bound, end = 0.0, cursors[pivot + 1][0] - 1 if pivot + 1 < len(cursors) else 1 << 60
            for cursor in cursors[: pivot + 1]:
                _, _, last, tops = lists[cursor[1]]
                block = cursor[2] // BLOCK
                while block < len(last) and last[block] < part:
                    block += 1
                if block < len(last):
                    bound += tops[block]
                    end = min(end, last[block])
            if bound < threshold:  # no part up to the nearest end of these blocks can reach it
                least = max(end, part) + 1
            else:
                least = part
                if cursors[0][0] == part:
                    score = sum(lists[c[1]][1][c[2]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((part, score))
                    least = part + 1
            cursors[: pivot + 1] = [c for c in cursors[: pivot + 1] if c[0] >= least or move(c, least)]
        return found


def small_letters(data: np.ndarray) -> np.ndarray:
    """The same for joined UTF-8 bytes."""
    capital = (data >= 0x41) & (data <= 0x5A)
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(capital, data + 0x20, data).astype(np.uint8)


def grams(tokens: list, n: int) -> set[tuple]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def overlap(own: list, gram_sets: dict[int, set], tokens: list) -> float:
    """Share of the runs of ``GRAM`` words (or of all, if fewer) of ``own`` that ``tokens`` have."""
    n = min(GRAM, len(own))
    if not n:
        return 1.0
    if n not in gram_sets:
        gram_sets[n] = grams(tokens, n)
    mine = [tuple(own[i : i + n]) for i in range(len(own) - n + 1)]
    return sum(g in gram_sets[n] for g in mine) / len(mine)


def finder(index: Index, kind: pa.DataType):
    search, item_words = Search(index, THRESHOLD), [[w.encode() for w in x] for x in index.words]
    struct = pa.struct([("item_id", kind), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def verified(text: bytes, windows: dict[int, list[int]], scores: dict[int, float]) -> list[dict]:
        tokens, out = WORD_BYTES.findall(text), []
        for item in sorted(windows):
            near = [w for k in sorted(set(windows[item])) for w in (*tokens[max(0, (k - 1) * PART) : (k + 3) * PART], None)]
            own, answer, sets = item_words[item], index.answers[item], {}
            question, last = overlap(own[:-answer], sets, near), overlap(own[-answer:], sets, near)
            if question >= QUESTION and last >= ANSWER:
                out.append({"item_id": index.items[item], "score": min(1.0, scores[item]), "question_overlap": question, "answer_overlap": last})
        return out

    def one(texts: pa.Array) -> pa.Array:
        found: list[list] = [[] for _ in range(len(texts))]
        data, bounds = raw(texts)
        data = small_letters(data)
        inside = IN_WORD[data]
        starts, ends, firsts = spans(inside, bounds)
        if len(starts) and len(index.terms):
            word, distinct = codes(data, inside, starts, ends)
            term = pc.fill_null(pc.index_in(distinct, value_set=search.vocabulary), -1).to_numpy(zero_copy_only=False)[word].astype(np.int64)
            length = np.diff(firsts)
            text = np.repeat(np.arange(len(texts)), length)
            # Blocks of PART words; two neighbours are a passage. One number is left out after each text's last block.
            many = -(-length // PART)
            first_block = np.concatenate([[0], np.cumsum(many + 1)])
            block = first_block[text] + (np.arange(len(word)) - firsts[text]) // PART
            v, known = len(index.terms), term >= 0
            keys = np.unique(block[known] * v + term[known])
            own_block, own_term = keys // v, keys % v
            later = np.searchsorted(keys, keys + v)
            both = (later < len(keys)) & (keys[np.minimum(later, len(keys) - 1)] == keys + v) if len(keys) else later > 0
            shared_block, shared_term = own_block[both], own_term[both]
            bound = np.zeros(first_block[-1])
            for most in index.coarse:  # where no range of parts can reach the threshold, the search would find no pivot
                of_block = np.bincount(own_block, most[own_term], first_block[-1] + 1)
                shared = np.bincount(shared_block, most[shared_term], first_block[-1])
                np.maximum(bound, of_block[:-1] + of_block[1:] - shared, out=bound)
            windows: dict[int, dict[int, list[int]]] = {}
            scores: dict[int, dict[int, float]] = {}
            for k in np.flatnonzero(bound >= search.threshold):
                t = int(np.searchsorted(first_block, k, "right") - 1)
                a, b = np.searchsorted(keys, [k * v, (k + 2) * v])
                for part, score in search.retrieve(np.unique(keys[a:b] % v)):
                    item = int(index.item_of[part])
                    windows.setdefault(t, {}).setdefault(item, []).append(int(k - first_block[t]))
                    best = scores.setdefault(t, {})
                    best[item] = max(best.get(item, 0.0), score)
            for t in windows:
                found[t] = verified(data[bounds[t] : bounds[t + 1]].tobytes(), windows[t], scores[t])
        return pa.array(found, pa.list_(struct))

    return one


def searches(items: DataFrame) -> list[Column]:
    """One column of found items, ``array<struct<item_id, score, question_overlap, answer_overlap>>``, for each index of items.

    Statistics are taken over all items. An index of about ``INDEX_PARTS`` parts goes to all tasks; a larger set of
    items is cut into several by the number of the item, each of which all documents are searched for.
    """
    spark = items.sparkSession
    ready(spark)
    told, parts = item_parts(items)
    scored = stage(postings(parts), "postings")
    count = parts.count()
    cut = max(1, -(-count // INDEX_PARTS))
    kind = items.schema["item_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = []
    for i in range(cut):
        own = F.pmod(F.xxhash64("number"), F.lit(cut)) == i
        index = build(scored.where(own).collect(), told.where(own).orderBy("number").collect())
        sent = spark.sparkContext.broadcast(index)
        returns = f"array<struct<item_id {kind}, score double, question_overlap double, answer_overlap double>>"
        out.append(on_texts(lambda sent=sent: finder(sent.value, arrow), returns)(F.col("text")))
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of all verified pairs, one row per pair and row of ``docs``.

    A null or empty text, or one without an item's words, has no rows. Items with the same text are all reported, an
    item without words never is; without items the result is empty. Repeated rows of ``docs`` repeat their pairs.
    """
    rows = [docs.select("doc_id", F.inline(found)) for found in searches(items)]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    for found in searches(items):
        docs = docs.where(F.size(found) == 0)
    return docs
