"""Hashed document features and a small softmax regression, shared by the classifiers.

Features are computed on the executors; only those of bounded samples reach the driver, where the
models are trained.  A model is a few hundred kilobytes and travels with the tasks that score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain
from operator import eq

import numpy as np
import xxhash

TEXT_BITS, META_BITS = 18, 10
_KINDS = str.maketrans({**{c: "a" for c in map(chr, range(97, 123))}, **{c: "A" for c in map(chr, range(65, 91))}, **{str(d): "0" for d in range(10)}})
_UPPER, _LOWER, _DIGIT, _SPACE = (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\n\r\v\f")


def _slot(name: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(name, 7) & ((1 << bits) - 1)


class WordSlots(dict):
    """Word to its two feature slots, the lower-cased word and its shape; bounded, starts anew when full."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, int]:
        kinds = word.translate(_KINDS)
        if len(word) > 64:  # whole, but not kept
            return _slot("w" + word.lower(), TEXT_BITS), _shape_slot.__wrapped__(kinds)
        if len(self) >= self.limit:
            self.clear()
        slots = self[word] = _slot("w" + word.lower(), TEXT_BITS), _shape_slot(kinds)
        return slots


@lru_cache(maxsize=20_000)
def _shape_slot(kinds: str) -> int:
    """The slot of a word's shape: its kinds of characters, runs taken together."""
    return _slot("s" + "".join(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1]), TEXT_BITS)


_words = WordSlots()


def text_features(text: str | None) -> np.ndarray:
    """Slots of a text's words, word shapes, and steps of how much it repeats itself, ascending; the last is constant."""
    found = (text or "").split()
    distinct, n = set(found), len(found)
    slots = set(chain.from_iterable(map(_words.__getitem__, distinct)))
    again = sum(map(eq, found, found[1:])) if len(distinct) < n else 0
    facts = (("follows itself", _share(again, n)), ("distinct", _share(len(distinct), n)), ("followers", again.bit_length()), ("letters a word", (len(text or "") // n).bit_length() if n else -1))
    slots.update(map(_fact_slot, facts))
    out = np.fromiter(chain(slots, (1 << TEXT_BITS,)), np.int64, len(slots) + 1)
    out.sort()
    return out


@lru_cache(maxsize=4096)
def _fact_slot(fact: tuple[str, int]) -> int:
    return _slot(f"{fact[0]}={fact[1]}", TEXT_BITS)


def _share(part: int, whole: int) -> int:
    """A share in steps, finer near nothing."""
    return int(20 * (part / whole) ** 0.5) if whole else -1


def meta_features(text: str | None, columns: dict[str, object]) -> np.ndarray:
    """Slots of what is known about a page besides its words: its columns, length and layout."""
    raw = (text or "").encode()
    lines = raw.split(b"\n")
    n = len(raw)
    count = lambda letters: n - len(raw.translate(None, letters))
    upper, lower, digit, space = map(count, (_UPPER, _LOWER, _DIGIT, _SPACE))
    high = n - len(raw.translate(None, bytes(range(128, 256))))
    facts = {
        "bytes": n.bit_length(),
        "lines": len(lines).bit_length(),
        "line bytes": (n // len(lines)).bit_length(),
        "repeated lines": _share(len(lines) - len(set(lines)), len(lines)),
        "upper": _share(upper, n),
        "digit": _share(digit, n),
        "space": _share(space, n),
        "marks": _share(n - upper - lower - digit - space - high, n),
    } | columns
    slots = np.unique([_slot(f"{k}={v}", META_BITS) for k, v in facts.items()])
    return np.append(slots, 1 << META_BITS)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def one_hot(classes: np.ndarray, n: int) -> np.ndarray:
    return np.eye(n)[classes]


def telling_slots(rows: list[np.ndarray], target: np.ndarray, size: int, keep: int) -> np.ndarray:
    """The ``keep`` slots whose presence depends most on the class (chi-squared), and the constant one; ascending."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slots = np.concatenate(rows)
    seen = np.stack([np.bincount(slots, t[owner], size) for t in target.T], axis=1)
    share = target.mean(axis=0)
    expected = seen.sum(axis=1, keepdims=True) * share
    strength = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1)
    strength[-1] = np.inf
    best = np.argsort(-strength, kind="stable")[:keep]
    return np.sort(best[strength[best] > 0])


@dataclass
class Model:
    """A softmax regression on the presence of some slots."""

    slots: np.ndarray
    weights: np.ndarray

    @cached_property
    def place(self) -> np.ndarray:
        """Where each slot's weights are; the row behind them, of zeros, for slots without."""
        place = np.full(int(self.slots[-1]) + 1, len(self.slots), np.int32)
        place[self.slots] = np.arange(len(self.slots))
        return place

    @cached_property
    def padded(self) -> np.ndarray:
        return np.vstack([self.weights, np.zeros(self.weights.shape[1])])

    def __getstate__(self) -> dict:
        return {"slots": self.slots, "weights": self.weights}

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(rows), self.weights.shape[1]))
        for k, row in enumerate(rows):
            at = self.place[row]
            out[k] = self.padded[np.sort(at[at < len(self.slots)])].sum(axis=0)
        return out

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        return softmax(self.logits(rows)) if rows else np.zeros((0, self.weights.shape[1]))


def train(rows: list[np.ndarray], target: np.ndarray, size: int, *, keep: int = 3000, ridge: float = 1e-3, steps: int = 150, rate: float = 0.2, offset: np.ndarray | None = None) -> Model:
    """Softmax regression on target probabilities (rows, classes), by Adam on the whole set; the constant isn't shrunk.

    ``offset`` (rows, classes) is added to the logits: what is known already, which the weights then correct.
    """
    classes = target.shape[1]
    slots = telling_slots(rows, target, size, keep)
    at = np.searchsorted(slots, np.concatenate(rows))
    at[at == len(slots)] = 0
    held = slots[at] == np.concatenate(rows)
    owner, at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[held], at[held]
    w, n = np.zeros((len(slots), classes)), len(rows)
    m, v = np.zeros_like(w), np.zeros_like(w)
    shrink = np.full((len(slots), 1), ridge)
    shrink[-1] = 0
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(owner, c[at], n) for c in w.T], axis=1)
        if offset is not None:
            z += offset
        error = (softmax(z) - target) / n
        grad = np.stack([np.bincount(at, e[owner], len(slots)) for e in error.T], axis=1) + shrink * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(slots, w)
