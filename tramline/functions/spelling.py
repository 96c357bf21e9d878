"""Spelling distance of words, for many pairs at once.

Slips of the hand and of the ear cost less than other changes. A batch of pairs is one array: each step handles one letter of all left words
against all letters of all right words, so Python runs once a letter and not once a pair.

The least cost of turning the first i letters of one word into the first j of another is the least of: a letter changed, a letter of the
left word dropped, a letter of the right word added, two neighbours swapped. The third looks along the row being made; as adding letters j + 1 to k always costs
the same, the row is a running minimum of what the other three give, less what adding the letters so far costs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rows of a keyboard (each half a key right of the one above), vowels, and what slips cost.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_VOWELS = "aeiouy"
SWAP, NEAR_KEY, VOWEL, DOUBLE, DIGIT = 0.6, 0.6, 0.7, 0.5, 1.5
#: Letters held at once: pairs times the longest right word.
CELLS = 1 << 20


def _table() -> np.ndarray:
    """What it costs to write one character for another, by code; 127 stands for all beyond ASCII."""
    cost = np.ones((128, 128))
    vowels, digits = ([ord(c) for c in held] for held in (_VOWELS, "0123456789"))
    cost[np.ix_(vowels, vowels)] = VOWEL
    keys = np.array([(ord(c), x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)])
    apart = np.abs(keys[:, None, 1:] - keys[None, :, 1:]).max(axis=2)
    first, second = np.nonzero(apart <= 1)
    cost[keys[first, 0].astype(int), keys[second, 0].astype(int)] = NEAR_KEY
    cost[digits, :] = cost[:, digits] = DIGIT
    return cost


_CHANGED = _table()


def _letters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded with -1, and their lengths."""
    size = np.array([len(w) for w in words])
    out = np.full((len(words), max(1, size.max(initial=0))), -1, np.int64)
    whole = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(out.shape[1]) < size[:, None]] = whole
    return out, size


def _alone(letters: np.ndarray, doubled: float) -> np.ndarray:
    """Cost of a letter more or less: `doubled` beside its like, else 1."""
    like = np.zeros(letters.shape, bool)
    like[:, 1:] = letters[:, 1:] == letters[:, :-1]
    like[:, :-1] |= like[:, 1:]
    return np.where(like, doubled, 1.0)


def distances(left: Sequence[str], right: Sequence[str], weighted: bool = True) -> np.ndarray:
    """Cost of each pair; without `weighted` every change, letter more or less, and swap costs 1 (a number of edits)."""
    out = np.empty(len(left))
    longest = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):
        # Pairs of like lengths go together, as many as fit.
        many = max(1, int(np.searchsorted(longest[order[at:]] * np.arange(1, len(order) - at + 1), CELLS)))
        own = order[at : at + many]
        out[own] = _block([left[k] for k in own], [right[k] for k in own], weighted)
        at += many
    return out


def _block(left: Sequence[str], right: Sequence[str], weighted: bool) -> np.ndarray:
    (a, size), (b, width) = _letters(left), _letters(right)
    drop, add = (_alone(x, DOUBLE if weighted else 1.0) for x in (a, b))
    swap = SWAP if weighted else 1.0
    added = np.concatenate((np.zeros((len(b), 1)), np.cumsum(add, axis=1)), axis=1)
    each, row, older = np.arange(len(a)), added.copy(), added
    out = np.where(size == 0, added[each, width], 0.0)
    for i in range(a.shape[1]):
        x = a[:, i : i + 1]
        same = x == b
        change = np.where(same, 0.0, _CHANGED[np.minimum(x, 127), np.minimum(b, 127)] if weighted else 1.0)
        new = row + drop[:, i : i + 1]
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + change)
        if i:
            crossed = same[:, :-1] & (a[:, i - 1 : i] == b[:, 1:]) & (x != a[:, i - 1 : i])
            new[:, 2:] = np.where(crossed, np.minimum(new[:, 2:], older[:, :-2] + swap), new[:, 2:])
        new = np.minimum.accumulate(new - added, axis=1) + added
        older, row = row, new
        done = size == i + 1
        out[done] = row[each[done], width[done]]
    return np.round(out, 9)


def spelling_cost(a: str, b: str) -> float:
    """Edit cost of two words with cheaper slips: swapped neighbours, a key beside, another vowel, a doubled letter; digits cost more."""
    return float(distances([a], [b])[0])


def _pairs(a: pd.Series, b: pd.Series, weighted: bool) -> pd.Series:
    held = a.notna() & b.notna()
    return pd.Series(distances(a[held].tolist(), b[held].tolist(), weighted), index=a.index[held], dtype="float64").reindex(a.index)


@F.pandas_udf(DoubleType())
def spelling(a: pd.Series, b: pd.Series) -> pd.Series:
    """spelling_cost of two columns; null where either is."""
    return _pairs(a, b, True)


@F.pandas_udf(DoubleType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of letters changed, added, dropped or swapped with their neighbour; null where either is."""
    return _pairs(a, b, False)
