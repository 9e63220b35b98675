"""Slow, plain Python counterparts for checking operators on small fixtures."""

import math
import re
from collections import Counter

from lexiloom.functions.fixed_values import STOP_WORDS

STOPS = set(STOP_WORDS)


def ngrams(tokens):
    kept = [t for t in tokens if t not in STOPS]
    return kept + [" ".join(pair) for pair in zip(kept, kept[1:])]


def keyword_terms(text):
    return ngrams(re.findall(r"\b[a-z]{3,}(?:-[a-z]{3,})*\b", text.lower()))


def search_terms(text):
    return ngrams(re.findall(r"\b[a-z0-9]{2,}\b", text.lower()))


def words(text):
    return re.findall(r"\b[a-z0-9]+(?:[-'][a-z0-9]+)*\b", text.lower())


class Tfidf:
    """Sublinear tf, smooth idf, unit rows, over a list of term lists."""

    def __init__(self, rows):
        df = Counter(t for row in rows for t in set(row))
        self.idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(self, terms):
        counts = Counter(t for t in terms if t in self.idf)
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}


def cosine(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())
