"""Windows of a fixed number of words: the functions that op12's tasks run to find passages that documents share.

Words are maximal runs without white space; a window is compared as its words joined by one space. Of the grams in a window the one
of the smallest hash stands for it: equal windows have equal grams, so a window whose smallest gram stands in no other text stands
in no other text, and neighbouring windows mostly have it in common (about 6 in 100 words are one, for 51 words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import SPACES

SPACE = np.isin(np.arange(256), list(SPACES.encode()))
#: Windows of which the hashes are computed at once.
BLOCK = 1 << 18


@dataclass
class Words:
    """The words of some texts, one after the other: *data* holds them joined by single spaces."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # of each word
    first: np.ndarray  # the first word of each text, and the number of all


def words_of(texts: list[np.ndarray]) -> Words:
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    space = SPACE[joined]
    after = np.concatenate(([True], space))[: len(space)]
    data = np.where(space, np.uint8(32), joined)[~(space & after)]
    blank = np.concatenate(([True], data == 32, [True]))
    starts, ends = np.flatnonzero(~blank[1:-1] & blank[:-2]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(np.flatnonzero(~space & after), begins)
    return Words(data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def grams_of(size: int) -> tuple[int, int]:
    """How many grams a window of *size* words holds (a power of two, at most two thirds) and the words of each."""
    m = 1 << max(0, (2 * size // 3).bit_length() - 1)
    return m, size - m + 1


def smallest_grams(words: Words, size: int, prints) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows by their first word, the smallest hash of a gram of each), for all windows that lie in one text.
    *prints* gives the fingerprints of data from starts to ends."""
    m, g = grams_of(size)
    n = len(words.starts) - size + 1
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        h = prints(words.data, words.starts[a : b + m - 1], words.ends[a + g - 1 : b + size - 1]).astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        step = 1
        while step < m:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        whole = words.text[a:b] == words.text[a + size - 1 : b + size - 1]
        if whole.any():
            yield np.flatnonzero(whole) + a, h[whole].astype(np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before them."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def once_each(text: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """*columns* with each of their rows once for each text that has it."""
    order = np.lexsort((*columns, text))
    columns = [c[order] for c in columns]
    told = changes(text[order], *columns)
    return [c[told] for c in columns]


def grams_once(words: Words, size: int, prints) -> np.ndarray:
    """The hashes of the grams that stand for windows, each once for each text."""
    text, h = [words.text[:0]], [np.zeros(0, np.int64)]
    for at, least in smallest_grams(words, size, prints):
        told = changes(words.text[at], least)
        text.append(words.text[at[told]])
        h.append(least[told])
    return once_each(np.concatenate(text), np.concatenate(h))[0]


def candidate_windows(words: Words, size: int, prints, known: np.ndarray) -> list[np.ndarray]:
    """For each text (first, last), one after the other, of its windows whose gram is among the *known* ones, which are sorted.
    Windows are counted from the text's first."""
    held = [words.starts[:0]]
    if len(known):
        for at, least in smallest_grams(words, size, prints):
            told = np.flatnonzero(changes(least))
            found = known[np.minimum(np.searchsorted(known, least[told]), len(known) - 1)] == least[told]
            held.append(at[np.repeat(found, np.diff(np.append(told, len(least))))])
    at = np.concatenate(held)
    text = words.text[at]
    cuts = np.flatnonzero(changes(at - np.arange(len(at)), text))
    text, last = text[cuts], at[np.append(cuts[1:], len(at)) - 1] if len(at) else at
    runs = np.stack((at[cuts], last), 1) - words.first[text][:, None]
    return [r.ravel() for r in np.split(runs, np.searchsorted(text, np.arange(1, len(words.first) - 1)))]


def windows_of(words: Words, runs: list[list[int]]) -> np.ndarray:
    """The windows of the texts' *runs*, ascending, by their first word."""
    out = [np.arange(a, b + 1) + first for first, r in zip(words.first.tolist(), runs) for a, b in np.reshape(np.array(r, np.int64), (-1, 2)).tolist()]
    return np.concatenate(out) if out else words.starts[:0]


def covered(words: Words, windows: np.ndarray, size: int) -> np.ndarray:
    """How many words of each text the *windows* cover."""
    edges = np.zeros(len(words.starts) + 1, np.int64)
    edges[windows] += 1
    edges[windows + size] -= 1
    return np.bincount(words.text[np.cumsum(edges[:-1]) > 0], minlength=len(words.first) - 1)
