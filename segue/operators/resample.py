"""Resampling with replacement whose counts every task works out alone.

A draw picks n of n rows.  How many of its picks fall into a block of rows follows
from halving: a node of a binary tree over the blocks splits its picks by a binomial
number that its own seed decides, so a task that wants one block walks one path.
Inside the block the picks are dealt row by row.  Nothing is shuffled or kept per draw.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024


def block_totals(block: int, n: int, draws: int, seed: int) -> np.ndarray:
    """Picks of every draw that fall into a block of ``BLOCK`` rows, of n rows in all."""
    low, high, counts = 0, -(-n // BLOCK), np.full(draws, n, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * BLOCK / (min(high * BLOCK, n) - low * BLOCK)
        left = np.random.default_rng([seed, low, high]).binomial(counts, share)
        if block < middle:
            counts, high = left, middle
        else:
            counts, low = counts - left, middle
    return counts


def multiplicities(block: int, n: int, draws: int, seed: int) -> np.ndarray:
    """How often each draw picks each row of a block: draws x rows."""
    totals, rows = block_totals(block, n, draws, seed), min(BLOCK, n - block * BLOCK)
    picks = np.random.default_rng([seed, block, block + 1, 1]).integers(0, rows, int(totals.sum()))
    owners = np.repeat(np.arange(draws), totals)
    return np.bincount(owners * rows + picks, minlength=draws * rows).reshape(draws, rows)
