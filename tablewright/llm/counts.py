"""Token counts by a tokenizer compiled into two deterministic transducers whose transitions carry counts.

The first reads characters by class and marks where the split pattern starts a word. Texts are
joined and cut into chunks of equal length, wherever they fall; each chunk gives a map from the
state at its begin to the state at its end, the maps compose through a parallel prefix scan, and
with the states so known all chunks mark their words side by side.

The second reads the bytes of a word. After a prefix of a word its state has the bytes that a
longer token may still begin in and, for each place in them, the last token before that place and
the tokens counted so far beyond the current place. A transition adds the change in the number of
tokens. Its table is compiled as words need it, from the merges alone.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import byte_characters
from .texts import characters, on_texts, raw, ready, strings

CHUNK = 1024  # characters
TRANSITIONS = 400_000  # compiled at most, then the table starts anew; no result depends on it

# Classes of characters. The letters of the endings 's 't 'm 'd 're 've 'll are told apart from others.
LETTER, NUMBER, SPACE, BLANK, MARK, OTHER, ENDING, R, V, L, E, END, NOTHING = range(13)
# States: after a text's end, in a run of letters, numbers or others, after one space, after one other blank, after several
# blanks with the last a space or not, after an apostrophe that begins a word, after one and r, v or l, after an ending.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ENDED = range(13)
STATES = CLASSES = 13
HERE, BEFORE = 1, 2  # a word starts at this character, at the one before


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state, times the number of classes, and output for each state and class, flat."""
    following, marks = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    letters = (LETTER, ENDING, R, V, L, E)
    kinds = {**dict.fromkeys(letters, WORD), NUMBER: DIGITS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, MARK: QUOTE, OTHER: SIGNS}

    def put(state: int, kind: int, to: int, mark: int) -> None:
        following[state, kind], marks[state, kind] = to, mark

    for state in range(STATES):
        for kind, to in kinds.items():
            put(state, kind, to, HERE)
        put(state, END, START, 0)
        put(state, NOTHING, state, 0)
    for kind in letters:
        put(WORD, kind, WORD, 0)
    put(DIGITS, NUMBER, DIGITS, 0)
    for kind in (MARK, OTHER):
        put(SIGNS, kind, SIGNS, 0)
        put(QUOTE, kind, SIGNS, 0)
    for state, mark in ((ONE_SPACE, 0), (TO_SPACE, BEFORE)):  # a last space belongs to the word after it
        for kind in (*letters, NUMBER, MARK, OTHER):
            put(state, kind, SIGNS if kind == MARK else kinds[kind], mark)
    for kind in (*letters, NUMBER, MARK, OTHER):  # a last blank that is no space stands alone
        put(TO_BLANK, kind, kinds[kind], BEFORE | HERE)
    for state in (ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK):
        put(state, SPACE, TO_SPACE, 0)
        put(state, BLANK, TO_BLANK, 0)
    for kind, to in ((ENDING, ENDED), (R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        put(QUOTE, kind, to, 0)
    for state, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        for kind in range(CLASSES - 1):  # no ending after all: the letter began a word
            put(state, kind, following[WORD, kind], marks[WORD, kind] | BEFORE)
        put(state, last, ENDED, 0)
    # A letter after an apostrophe that may begin an ending is marked late, by the transitions above.
    return (following * CLASSES).ravel().astype(np.uint8), marks.ravel()


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of every code point; surrogates, which no text has, are OTHER."""
    table = np.full(0x110000, OTHER, np.uint8)
    for start, part in characters():
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            table[[start + m.start() for m in regex.finditer(pattern, part)]] = kind
    for members, kind in ((" ", SPACE), ("'", MARK), ("stmd", ENDING), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in members]] = kind
    return table


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each character; ``classes`` has END after every text."""
    following, marks = split_transducer()
    count = -(-len(classes) // CHUNK)
    padded = np.full(count * CHUNK, NOTHING, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(count, CHUNK).T)  # one row for each place in a chunk

    maps = np.tile(np.arange(STATES, dtype=np.uint8) * np.uint8(CLASSES), (count, 1))
    step = 0
    while step < CHUNK and not (maps == maps[:, :1]).all():  # until no chunk depends on the state it began in
        for column in columns[step : step + 32]:
            maps = following[maps + column[:, None]]
        step += 32
    if step < CHUNK:
        state = maps[:, 0]
        for column in columns[step:]:
            state = following[state + column]
        maps = np.repeat(state[:, None], STATES, 1)

    maps = maps // CLASSES
    reach = 1
    while reach < count:  # the scan: afterwards a chunk's map reaches back to the first chunk
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), 1)
        reach *= 2

    state = np.full(count, START * CLASSES, np.uint8)
    state[1:] = maps[:-1, START] * CLASSES
    found = np.empty_like(columns)
    for place, column in enumerate(columns):
        at = state + column
        found[place] = marks[at]
        state = following[at]
    found = found.T.ravel()[: len(classes)]
    starts = (found & HERE) > 0
    starts[:-1] |= (found[1:] & BEFORE) > 0
    return starts


class Words:
    """The transducer of words, compiled from a tokenizer's merges as far as words have needed it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        back = {c: b for b, c in enumerate(byte_characters())}
        join = lambda token: bytes(back[c] for c in token)
        self.special = [x["content"].encode() for x in told["added_tokens"]]
        names = {x["content"] for x in told["added_tokens"]}
        self.tokens = {join(t) for t in told["model"]["vocab"] if t not in names}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])
        self.ranks = {(join(a), join(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.open = {t[:i] for t in self.tokens for i in range(1, len(t))}  # what a longer token begins with
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        """State 0 is the start of a word: no byte is open, and no token stands before it."""
        self.states: list[tuple] = [(b"", ((None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.table: dict[int, int] = {}  # state and byte: next state, and the change plus 128

    def merge(self, word: bytes) -> list[bytes]:
        """The tokens of a short word, merge by merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, len(self.ranks)) for pair in zip(parts, parts[1:])]
            if (best := min(ranks)) == len(self.ranks):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: bytes | None, right: bytes) -> bool:
        """Whether two tokens stay apart; tokens of a word are the one way to divide it in which all neighbours do."""
        key = (left or b"", right)
        if key not in self.fits:
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            self.fits[key] = self.merge(key[0] + right) == ([left, right] if left else [right])
        return self.fits[key]

    def compile(self, state: int, byte: int) -> int:
        """The transition from a state on a byte: next state and change of the count."""
        held, places = self.states[state]
        now = held + bytes([byte])
        for i in range(len(now)):  # the last token now, the longest that fits the tokens before it
            token, place = now[i:], places[i]
            if place is not None and token in self.tokens and self.may_follow(place[0], token):
                change = place[1] + 1
                break
        places = (*places, (token, change))
        kept = next(i for i in range(len(now) + 1) if i == len(now) or now[i:] in self.open)
        target = (now[kept:], tuple(
            (places[i][0], places[i][1] - change) if places[i] and (i == len(now) or now[i:] in self.open) else None
            for i in range(kept, len(now) + 1)
        ))
        if target not in self.numbers:
            self.numbers[target] = len(self.states)
            self.states.append(target)
        found = self.table[state << 8 | byte] = self.numbers[target] << 8 | change + 128
        return found

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word."""
        if len(self.table) > TRANSITIONS:
            self.forget()
        table, found = self.table, []
        for word in words:
            state = total = 0
            for byte in word:
                step = table.get(state << 8 | byte)
                if step is None:
                    step = self.compile(state, byte)
                state = step >> 8
                total += (step & 255) - 128
            found.append(total)
        return np.array(found, np.int64)


@lru_cache(1)
def compiled(path: str) -> Words:
    """One transducer for all tasks of a worker."""
    return Words(path)


def marked(texts: pa.Array, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes with FE after each text and FF in place of each special string, and the n + 1 bounds."""
    data, bounds = raw(texts)
    data, bounds = np.insert(data, bounds[1:], 0xFE), bounds + np.arange(len(bounds))
    joined = data.tobytes()
    for token in special:
        if token in joined:
            first = np.array([m.start() for m in regex.finditer(regex.escape(token), joined)])
            gone = np.zeros(len(data), bool)
            for i in range(1, len(token)):
                gone[first + i] = True
            data[first] = 0xFF
            left = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~gone, out=left[1:])
            data, bounds = data[~gone], left[bounds]
            joined = data.tobytes()
    return data, bounds


def code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Code points of well-formed UTF-8 at its lead bytes."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    first = data[leads]
    points = first.astype(np.uint32)
    for least, head, tail in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero((first >= least) & (first < 0xFE))
        value = (first[at] & head).astype(np.uint32)
        for i in range(1, tail + 1):
            value = value << 6 | (padded[leads[at] + i] & 0x3F)
        points[at] = value
    return points


def counter(words: Words):
    def one(texts: pa.Array) -> pa.Array:
        data, bounds = marked(texts, words.special)
        if not len(data):
            return pa.array(np.zeros(len(texts), np.int64))
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        classes = character_classes()[code_points(data, leads)]
        stops = data[leads] >= 0xFE
        classes[stops] = END
        cuts = leads[word_starts(classes) | stops]
        found = strings(data, np.append(cuts, len(data)), pa.large_binary()).dictionary_encode()
        parts = found.dictionary.to_pylist()
        of = words.count([b"" if x[0] >= 0xFE else x for x in parts])
        of[[i for i, x in enumerate(parts) if x == b"\xff"]] = 1
        total = np.zeros(len(cuts) + 1, np.int64)
        np.cumsum(of[found.indices.to_numpy(zero_copy_only=False)], out=total[1:])
        return pa.array(np.diff(total[np.searchsorted(cuts, bounds)]))

    return one


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of a whole text for the byte-level tokenizer file at ``path``; a null or empty text has none.

    Strings of the file's special tokens count as one token each, as the library takes them by default; nothing is
    added, cut off or filled up.
    """
    return on_texts(lambda: counter(compiled(path)), "long")(text)


def measure(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row; columns of these names are replaced."""
    ready(docs.sparkSession)
    return docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn(
        "n_tokens", count_tokens(F.col("text"), path)
    ).withColumn("over_limit", F.col("n_tokens") > limit)
