"""Plain versions of the operators, one text at a time."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small_letters(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rule_counts(text):
    text = text or ""
    words, seen, equal = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        equal += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), equal, len(covered)


def fingerprint(text, size=3):
    words = WORD.findall(small_letters(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingle_set(text, size=5):
    words = WORD.findall(small_letters(text))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])


def groups(n, linked):
    """Group number of each of n things, by their smallest member."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a in range(n):
        for b in range(a):
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(n)]


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a or b else 0.0


def phrases(text, told):
    words, starts, labels = ALNUM.findall(small_letters(text)), [], set()
    for phrase, label in told.items():
        own = phrase.split()
        found = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
