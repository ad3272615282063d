"""Least values of sliding windows, the choice that makes seeds follow from content alone."""

from __future__ import annotations

import numpy as np


def least_places(rank: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values the place of its least value, the first among equals.

    Ranks are below 2^40 and there are at most 2^24 of them. Running minima from both ends of
    blocks of `width` give every window in a few passes."""
    count = len(rank) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    key = rank.astype(np.uint64) << np.uint64(24) | np.arange(len(rank), dtype=np.uint64)
    full = -(-len(key) // width) * width
    blocks = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(key)] = key
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:count], head[width - 1:width - 1 + count])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)
