"""Checks of single sequences on the driver; `functions.sequence` has the same as columns."""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from itertools import accumulate

from ..sources.sites import reverse_complement

_BIT = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8}


def _occurs(seq: str, length: int, least: int, most: int | None, partner) -> bool:
    s = seq.upper().replace("U", "T")
    for i in range(len(s) - 2 * length - least + 1):
        start = i + length + least
        stop = len(s) if most is None else i + 2 * length + most
        if s.find(partner(s[i : i + length]), start, stop) >= 0:
            return True
    return False


def contains_direct_repeat(seq: str, repeat_length: int, min_distance: int = 0, max_distance: int | None = None) -> bool:
    return _occurs(seq, repeat_length, min_distance, max_distance, lambda w: w)


def contains_inverted_repeat(seq: str, repeat_length: int, min_distance: int = 0, max_distance: int | None = None) -> bool:
    return _occurs(seq, repeat_length, min_distance, max_distance, reverse_complement)


def contains_hairpin(seq: str, stem_length: int, min_loop_length: int = 0, max_loop_length: int | None = None) -> bool:
    return contains_inverted_repeat(seq, stem_length, min_loop_length, max_loop_length)


def sequence_masks(seq: str) -> list[int]:
    """A 1, C 2, G 4, T and U 8."""
    return [_BIT[c] for c in seq.upper()]


def choice_masks(choices: Iterable[str]) -> list[int]:
    """For each place the masks of all choices or-ed; the choices must have one length."""
    rows = [sequence_masks(c) for c in choices]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("All choices must have the same length.")
    out = [0] * (len(rows[0]) if rows else 0)
    for row in rows:
        out = [a | b for a, b in zip(out, row)]
    return out


def pack_masks(masks: Iterable[int]) -> int:
    """Masks as one integer, four bits each, the first lowest."""
    return sum(m << 4 * i for i, m in enumerate(masks))


class Sampler:
    """Draws items with replacement, evenly or by weights; the only item of one takes no random number."""

    def __init__(self, items: Sequence, weights: Sequence[float] | None = None, seed=None):
        self.items, self.rng = tuple(items), random.Random(seed)
        if not self.items:
            raise ValueError("There is nothing to sample from.")
        if weights is not None and (len(weights) != len(self.items) or min(weights) < 0 or not sum(weights) > 0):
            raise ValueError("Weights must be non-negative, one for each item, with a positive sum.")
        total = sum(weights or ())
        self.ladder = None if weights is None or len(set(weights)) == 1 else [x / total for x in accumulate(weights)]

    def sample(self, n: int | None = None):
        if n is not None:
            return [self.sample() for _ in range(n)]
        if len(self.items) == 1:
            return self.items[0]
        if self.ladder is None:
            return self.items[int(self.rng.random() * len(self.items))]
        return self.items[min(bisect_left(self.ladder, self.rng.random()), len(self.items) - 1)]
