"""Rank of a match: how often and how near to each other its lexemes stand."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The weight of a plain position, the sum of 1/j^2, and what pairs beyond 100 positions count.
WEIGHT, ALL_SQUARES, FAR = 0.1, 1.64493406685, 1e-30


def _nearness(distance: np.ndarray) -> np.ndarray:
    return np.where(distance > 100, FAR, 1.0 / (1.005 + 0.05 * np.exp(np.minimum(distance, 101) / 1.5 - 2.0)))


#: 1 less what a pair counts, for differences of -101 to 101; one place isn't a pair.
_FACTORS = 1.0 - np.sqrt(WEIGHT * WEIGHT * _nearness(np.abs(np.arange(-101, 102))))
_FACTORS[101] = 1.0


@lru_cache(maxsize=256)
def _alone(n: int) -> float:
    return float((WEIGHT / np.arange(1, n + 1) ** 2).sum()) / ALL_SQUARES


def rank(places: dict[str, list[int]], query: list[str]) -> float:
    """0 without a match; one lexeme counts by its occurrences, several by all pairs of their positions.

    An analyzed text keeps 256 positions of a lexeme, so that the pairs of two lexemes are 65,536 at most.
    """
    found = [places.get(q) for q in query]
    if not query or not all(found):
        return 0.0
    if len(query) == 1:
        return _alone(len(found[0]))
    apart, rest = 1.0, np.array([at for f in found for at in f])
    for one in found[:-1]:
        # a lexeme's positions against those of all lexemes after it
        own, rest = rest[: len(one)], rest[len(one) :]
        apart *= float(_FACTORS.take(np.subtract.outer(own + 101, rest), mode="clip").prod())
    return 1.0 - apart
