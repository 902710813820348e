"""Fuzzy scores: the best alignment of a query as a subsequence of a value.

Two matrices, as the public description of the matcher has them. With p_i the
i-th character of the query and v_j the j-th of the value,

    M[i][j]  best score of p_1..p_i in v_1..v_j where p_i is matched with v_j
    P[i][j]  the same where v_j is skipped
    M[i][j] = match(i, j) + max(M[i-1][j-1] + run(i-1, j-1, j), P[i-1][j-1] + place(j))
    P[i][j] = max(M[i][j-1] + GAP_START + GAP_MORE, P[i][j-1] + GAP_MORE)
    P[0][j] = GAP_MORE, M[0][j] = minus infinity

and the score is the greatest M of the last character. place(j) is what v_j
earns by where it stands; a character that follows a matched one earns the most
of RUN, its own place, and what the run earned before it. Letter case is that of
ASCII and counts only if the query has an upper-case letter.

All values of a batch go through the matrices together, a row of both for each
character of the query; P is a running maximum. Only values that hold the query
as a subsequence leave the JVM: a pattern of negated classes that give nothing
back finds them in one pass over each value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores of a match, of gaps, of places, of a run and of another case; the factor of the first place.
MATCH, GAP_START, GAP_MORE, HEAD, BREAK, CAMEL, RUN, CASE, FIRST = 16, -3, -1, 8, 7, 6, 4, -2, 2
#: Signs after which a word begins, and signs that part it.
HARD, SOFT = " /\\|()[]{}", "!\"#$%&'*+,-.:;<=>?@^_`~"
#: Cells of a matrix row over all values that are worked on together.
CELLS = 1 << 17
_LOWER, _UPPER, _DIGIT, _SOFT, _HARD = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(128, _LOWER, np.int8)
    for signs, kind in ((HARD, _HARD), (SOFT, _SOFT), ("0123456789", _DIGIT), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER)):
        kinds[[ord(c) for c in signs]] = kind
    return kinds


_KINDS = _kinds()


def case_counts(query: str) -> bool:
    return any("A" <= c <= "Z" for c in query)


def _folded(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= ord("A")) & (codes <= ord("Z")), codes + 32, codes)


def _places(codes: np.ndarray) -> np.ndarray:
    """What each character earns by the one before it."""
    kind = np.where(codes < 128, _KINDS[np.clip(codes, 0, 127)], _LOWER)
    before = kind[:-1]
    camel = (kind[1:] == _UPPER) & ((before == _LOWER) | (before == _DIGIT))
    place = np.empty(codes.shape, np.int32)
    place[0] = HEAD * FIRST
    place[1:] = np.select([before == _HARD, before == _SOFT, camel], [HEAD, BREAK, CAMEL], 0)
    return place


def _aligned(codes: np.ndarray, query: str) -> np.ndarray:
    """Scores of values, a column of code points each, filled up with -1; 0 where the query is no subsequence.

    A value has a column, so that each step is one of rows over all values; row 0 of a
    matrix is the place before the first character.
    """
    width, n = codes.shape
    small = width + len(query) * (MATCH + HEAD * FIRST) < 1 << 13
    number, lowest = (np.int16, -(1 << 14)) if small else (np.int32, -(1 << 29))
    place, strict = _places(codes).astype(number), case_counts(query)
    own = codes if strict else _folded(codes)
    steps = (GAP_MORE * np.arange(width + 1)).astype(number)[:, None]
    matched, skipped, run = np.full((width + 1, n), lowest, number), np.full((width + 1, n), GAP_MORE, number), np.zeros((width + 1, n), number)
    place_or_run = np.maximum(place, number(RUN))
    other_case = number(0) if strict else np.where(own != codes, number(CASE), number(0))  # no letter of the query is upper-case then
    for ch in query:
        same = own == ord(ch)
        earned = np.maximum(run[:-1], place_or_run)
        along, after = matched[:-1] + earned, skipped[:-1] + place
        run[1:] = np.where(along >= after, earned, place)
        best = np.maximum(along, after, out=along)
        best += number(MATCH)
        best += other_case
        matched[1:] = np.where(same, best, number(lowest))
        opened = np.maximum.accumulate(matched - steps, axis=0)  # the best end so far, its gap paid to here
        skipped[0] = lowest
        np.maximum(opened[:-1] + (steps[1:] + number(GAP_START)), number(lowest), out=skipped[1:])
    best = matched.max(axis=0)
    return np.where(best > lowest // 2, best, 0).astype(np.int64)


def scores(values: list[str | None], query: str) -> np.ndarray:
    """The score of the query in each value; 0 for an empty query, an empty or null value and where it is no subsequence."""
    out = np.zeros(len(values), np.int64)
    if not query:
        return out
    order = sorted((k for k, v in enumerate(values) if v and len(v) >= len(query)), key=lambda k: len(values[k]))
    at = 0
    while at < len(order):  # values of like length together
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(values[order[to]]) <= CELLS:
            to += 1
        width = len(values[order[to - 1]])
        codes = np.full((to - at, width), -1, np.int32)
        for row, k in enumerate(order[at:to]):
            own = np.frombuffer(values[k].encode("utf-32-le", "surrogatepass"), np.int32)
            codes[row, : len(own)] = own
        out[order[at:to]] = _aligned(np.ascontiguousarray(codes.T), query)
        at = to
    return out


def subsequence(query: str) -> str:
    """A pattern that finds the values which hold the query as a subsequence, in one pass over each."""
    parts = []
    for ch in query:
        either = ch if case_counts(query) or not ("a" <= ch <= "z") else ch + ch.upper()
        signs = "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in either)
        parts.append(f"[^{signs}]*+[{signs}]")
    return "^" + "".join(parts)


def fuzzy(c: Column, query: str) -> Column:
    """The score of the query in c, 0 also where the gaps cost more than the matches earn; only values
    that hold the query as a subsequence go through Python."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.maximum(scores(batch.to_pylist(), query), 0))

    return run(F.when(c.rlike(subsequence(query)), c)) if query else F.lit(0).cast("long")
