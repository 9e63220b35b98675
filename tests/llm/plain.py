"""Plain versions of the operators, for small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(_UPPER, _UPPER.lower())
STOPS = "the of and to in a is that for it".split()


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(rng.choice(STOPS) if rng.random() < 0.35 else "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(4, 9))))
    return " ".join(out)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Number of shingles, smallest linked id and number of links for each row number."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    groups = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        groups[find(x)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(len(sets[x]), least[find(x)], links[x]) for x in range(len(rows))]


def cut_repeats(texts, window):
    """Bytes kept, bytes removed and spans for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((bytes(x for x, g in zip(b, gone) if not g), sum(gone), spans))
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def base_scores(rows):
    """Tokens, known tokens and the base score of each row, and all training tokens."""
    split = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    trains = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i, _ in rows]
    counts = Counter(w for s, ok in zip(split, trains) if ok for w in s)
    n, v = sum(counts.values()), len(counts)
    return [(len(s), sum(counts[w] > 0 for w in s), math.fsum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)) for s in split], n


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
