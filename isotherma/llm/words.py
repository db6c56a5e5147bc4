"""Hashed words and shingles of many texts at once.

Words are runs of bytes other than space and the control characters 9 to 13, with A-Z lower-cased. A word's hash is a sum of fixed
random values of its bytes times fixed random odd values of their places, then finalised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .store import mixed, stream

BYTE = stream(256, 11)
PLACE = stream(1 << 12, 12) | np.uint64(1)
SHINGLE = stream(64, 13) | np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
VALUE = np.where(WHITE, np.uint64(0), BYTE)


@dataclass(frozen=True)
class Words:
    data: np.ndarray  # bytes of all texts, lower-cased, a newline after each text
    white: np.ndarray
    text_ends: np.ndarray  # where each text ends in data, its newline included
    hashes: np.ndarray
    owner: np.ndarray  # the text of each word


def hashed_words(rows: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join([*rows, b""]).lower(), np.uint8)
    ends = np.cumsum(np.array([len(x) + 1 for x in rows], np.int64))
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return Words(data, white, ends, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    lengths = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = VALUE[data[starts[0] :]]
    value *= PLACE[place & (len(PLACE) - 1)]
    far = place >= len(PLACE)
    if far.any():  # words of more than 4096 bytes
        value[far] *= mixed(place[far].astype(np.uint64), 14) | np.uint64(1)
    hashes = mixed(np.add.reduceat(value, starts - starts[0]))
    return Words(data, white, ends, hashes, np.searchsorted(ends, starts, side="right"))


def shingles(words: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their texts; a text of fewer words gives its whole sequence as one; empty texts none.

    Ordered by text, not distinct.
    """
    counts = np.bincount(words.owner, minlength=n_texts)
    out = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    h = words.hashes
    if len(h) >= size:
        n = len(h) - size + 1
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += h[k : k + n] * SHINGLE[k]
        inside = words.owner[:n] == words.owner[size - 1 :]
        out, owner = mixed(total[inside], size), words.owner[:n][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        more = [mixed(np.array([(h[first[t] : first[t + 1]] * SHINGLE[: counts[t]]).sum(dtype=np.uint64)], np.uint64), int(counts[t]))[0] for t in short]
        out, owner = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def shingle_sets(rows: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    values, owner = shingles(hashed_words(rows), len(rows), size)
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    return [_distinct(values[a:b]) for a, b in zip(edges, edges[1:])]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
