"""Texts as numpy arrays of code points or bytes, a bounded part of a batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text makes a part of its own.
PART = 1_000_000


def give_back() -> None:
    """Return memory that is free to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, after which its worker gives memory back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def parts(texts: list[str], limit: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters in all."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text begins."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return codes, np.concatenate(([0], np.cumsum(sizes)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values; the last value must be false."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0))
    return edges[0::2], edges[1::2]


def hash_runs(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of codes; equal runs have equal hashes."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    mixed = mix64(codes.astype(np.uint64) + np.uint64(1))
    place = np.arange(len(codes), dtype=np.int64)
    first = np.zeros(len(codes), dtype=np.int64)
    first[begins] = begins
    place -= np.maximum.accumulate(first)
    powers = np.cumprod(np.full(int((ends - begins).max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    mixed *= powers[np.minimum(place, len(powers) - 1)]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    return mix64((sums[ends] - sums[begins]) ^ (ends - begins).astype(np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def owners(begins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which text each run belongs to."""
    return np.searchsorted(bounds, begins, side="right") - 1


def distinct_in(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each owner."""
    key = mix64(value ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    return np.bincount(owner[at], minlength=n)
