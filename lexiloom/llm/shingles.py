"""Hashed word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: One random odd-looking value for each byte, from a fixed seed.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (whole == 32) | ((whole >= 9) & (whole <= 13))
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    stops = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    letters = whole[~blank]
    if lower:
        letters = letters + np.uint8(32) * ((letters >= 65) & (letters <= 90)).astype(np.uint8)
    lengths = stops - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    within = np.arange(len(letters)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(_BYTE[letters] * powers[within], first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return mix(hashes + lengths.astype(np.uint64)), per_text


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than ``size`` words make one, none make none."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    if len(hashes):
        weights = np.full(size, _STEP)
        weights[0] = 1
        weights = np.cumprod(weights, dtype=np.uint64)
        padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
        rolled = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            rolled += padded[k:k + len(hashes)] * weights[k]
        rolled = mix(rolled)
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at:at + n - size + 1]))
        elif n:
            out.append(mix(np.array([np.sum(hashes[at:at + n] * weights[:n], dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit value of a set, its size included."""
    total = np.sum(mix(tokens ^ _STEP), dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def in_parts(rows: Iterator, limit: int = 4_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Arrow batches of ``key, text`` as lists of keys and encoded texts, of about ``limit`` bytes."""
    keys, texts, held = [], [], 0
    for batch in rows:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "replace")
            keys.append(key)
            texts.append(raw)
            held += len(raw)
            if held >= limit or len(keys) >= 50_000:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts
