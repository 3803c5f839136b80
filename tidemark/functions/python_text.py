"""The two text functions no built-in expresses: signed word hits that need
match offsets, and the matching-block similarity ratio.  Both are Arrow-batched
and see only the rows that need them."""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fv


class DirectionScorer:
    """Sign of the summed word hits of one statement; a negation among the few
    words before a hit turns the hit around."""

    def __init__(self, positive=fv.DIRECTION_POSITIVE, negative=fv.DIRECTION_NEGATIVE, negation=fv.NEGATION):
        self.signed = [(re.compile(p, re.I), 1) for p in positive] + [(re.compile(p, re.I), -1) for p in negative]
        self.negation = re.compile(negation, re.I)
        self.word = re.compile(r"[A-Za-z']+")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for pattern, sign in self.signed:
            for hit in pattern.finditer(text):
                lead = self.word.findall(text, max(0, hit.start() - fv.NEGATION_PREFIX_CHARS), hit.start())
                turned = self.negation.search(" ".join(lead[-fv.NEGATION_LOOKBACK_WORDS:]))
                total += -sign if turned else sign
        return (total > 0) - (total < 0)


def direction_score(positive=fv.DIRECTION_POSITIVE, negative=fv.DIRECTION_NEGATIVE, negation=fv.NEGATION):
    """Column function: array of texts -> array of -1/0/1 (NULL text scores 0)."""
    scorer = DirectionScorer(positive, negative, negation)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def score_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda facts: None if facts is None else [scorer(t) for t in facts])

    return score_all


def line_direction(positive=fv.DIRECTION_POSITIVE, negative=fv.DIRECTION_NEGATIVE, negation=fv.NEGATION):
    """Column function: one text -> -1/0/1 (NULL scores 0)."""
    scorer = DirectionScorer(positive, negative, negation)

    @F.pandas_udf(T.IntegerType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer(t) for t in texts], dtype="int32")

    return score


@lru_cache(maxsize=200_000)
def title_ratio(later: str, earlier: str) -> float:
    """Matching-block similarity of two titles."""
    if not later or not earlier:
        return SequenceMatcher(None, later, earlier).ratio()
    by_places = len(earlier) >= AUTOJUNK or len(later) * len(earlier) > MAX_CELLS
    return 2.0 * (matched_by_places if by_places else matched)(later, earlier) / (len(later) + len(earlier))


#: From this length on ``difflib`` leaves out the common letters of the earlier title.
AUTOJUNK = 200
#: Pairs of letters that :func:`matched` marks in one integer.
MAX_CELLS = 200_000


@lru_cache(maxsize=2_000)
def letter_places(earlier: str) -> dict[str, list[int]]:
    """Where ``difflib`` looks for the letters of the earlier title, found once for all later ones."""
    return SequenceMatcher(None, "", earlier).b2j


def matched_by_places(later: str, earlier: str) -> int:
    """:func:`matched` for an ``earlier`` of any length: as ``difflib`` does it, but only letters with places are visited.

    In a long title few letters have places; a run of these is extended by whatever letters are equal.
    """
    places = letter_places(earlier)
    at = [i for i, c in enumerate(later) if c in places]
    found, open_ = 0, [(0, len(later), 0, len(earlier))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        i, j, size = alo, blo, 0
        runs, last = {}, -2
        for x in at[bisect_left(at, alo):bisect_left(at, ahi)]:
            longer = {}
            before = runs if x == last + 1 else {}
            spots = places[later[x]]
            for y in spots[bisect_left(spots, blo):bisect_left(spots, bhi)]:
                n = longer[y] = before.get(y - 1, 0) + 1
                if n > size:
                    i, j, size = x - n + 1, y - n + 1, n
            runs, last = longer, x
        while i > alo and j > blo and later[i - 1] == earlier[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and later[i + size] == earlier[j + size]:
            size += 1
        if size:
            found += size
            if alo < i and blo < j:
                open_.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                open_.append((i + size, ahi, j + size, bhi))
    return found


def matched(later: str, earlier: str) -> int:
    """Letters in the matching blocks that ``difflib`` finds; ``earlier`` is shorter than ``AUTOJUNK``.

    All pairs of equal letters are the set bits of one integer, a row of ``w`` bits
    for each letter of ``later``. The integer moved by a row and a bit and met with
    itself keeps the starts of longer and longer runs; the lowest bit that is left is
    the first of the longest. What lies before and behind it is searched likewise.
    """
    width = len(earlier) // 8 + 1  # the last bit of a row is never set, so no run goes on in the next one
    w = 8 * width
    places: dict[str, int] = {}
    for j, c in enumerate(earlier):
        places[c] = places.get(c, 0) | 1 << j
    rows, none = {c: x.to_bytes(width, "little") for c, x in places.items()}, bytes(width)
    firsts = int.from_bytes((b"\1" + bytes(width - 1)) * len(later), "little")
    found, step = 0, w + 1
    cells = int.from_bytes(b"".join([rows.get(c, none) for c in later]), "little")
    open_ = [(cells, len(later), 0, len(earlier))] if cells else []
    while open_:
        cells, n, low, high = open_.pop()
        size, starts = 1, cells
        while longer := (starts >> step) & cells:
            size, starts = size + 1, longer
        i, j = divmod((starts & -starts).bit_length() - 1, w)
        found += size
        first = firsts & ((1 << i * w) - 1)
        if i and j > low and (before := cells & ((first << j) - (first << low))):
            open_.append((before, i, low, j))
        i, j = i + size, j + size
        first = firsts & ((1 << (n - i) * w) - 1)
        if i < n and j < high and (after := (cells >> i * w) & ((first << high) - (first << j))):
            open_.append((after, n - i, j, high))
    return found


def at_least(later: str, earlier: str, threshold: float) -> bool:
    """``title_ratio >= threshold``; two cheap upper bounds are tried first."""
    total = len(later) + len(earlier)
    if total and 2.0 * min(len(later), len(earlier)) / total < threshold:
        return False
    shared = sum((letters(later) & letters(earlier)).values())
    if total and 2.0 * shared / total < threshold:
        return False
    return title_ratio(later, earlier) >= threshold


@lru_cache(maxsize=100_000)
def letters(title: str) -> Counter:
    """Letter counts; no matching can share more than these overlap."""
    return Counter(title)


@F.pandas_udf(T.DoubleType())
def similarity(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """Column form of :func:`title_ratio`."""
    return pd.Series([None if a is None or b is None else title_ratio(a, b) for a, b in zip(later, earlier)])
