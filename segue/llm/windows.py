"""Hashes of words and word windows, and hash buckets as compact rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view

_MIX, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, found), dtype=np.uint64, count=len(found))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    acc = np.zeros(max(len(hashes) - k + 1, 0), dtype=np.uint64)
    for j in range(k if len(acc) else 0):
        acc = (acc ^ hashes[j:j + len(acc)]) * _MIX
        acc ^= acc >> np.uint64(29)
    acc *= _FINAL
    return acc ^ (acc >> np.uint64(32))


def smallest(all_grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash of each run of ``width`` (the last of equal ones)."""
    if width == 1 or len(all_grams) < width:
        return np.arange(max(len(all_grams) - width + 1, 0))
    reverse = sliding_window_view(all_grams, width)[:, ::-1]
    return np.arange(len(reverse)) + width - 1 - reverse.argmin(axis=1)


def winnow(hashes: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest k-gram of every window of n words."""
    all_grams = grams(hashes, k)
    at = np.unique(smallest(all_grams, n - k + 1))
    return at, all_grams[at]


def to_buckets(first: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row per bucket of the leading hash: the bucket's number and each column as packed numbers."""
    bucket = (first >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], len(bucket)]
    packed = [[c[order[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist())] for c in columns]
    return pa.record_batch([pa.array(bucket[starts], pa.int64()), *[pa.array(p, pa.binary()) for p in packed]],
                           names=["bucket", *[f"c{i}" for i in range(len(columns))]])


def by_bucket(batches: Iterator[pa.RecordBatch], types: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after the other, from rows sorted by bucket."""
    held: list[list[bytes]] = [[] for _ in types]
    current = None
    for batch in batches:
        for number, *row in zip(*(batch.column(i).to_pylist() for i in range(len(types) + 1))):
            if number != current and current is not None:
                yield [np.frombuffer(b"".join(h), dtype=t) for h, t in zip(held, types)]
                held = [[] for _ in types]
            current = number
            for h, value in zip(held, row):
                h.append(value)
    if current is not None:
        yield [np.frombuffer(b"".join(h), dtype=t) for h, t in zip(held, types)]


def lists_by(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Each distinct key with a list of its values in every column."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.r_[starts, len(key)].astype(np.int32), pa.int32())
    return sorted_[starts], [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]
