"""XXH64 of many short slices of one byte array at once (the public xxHash specification)."""

from __future__ import annotations

import numpy as np

# The primes of XXH64.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def xxh64_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of data[starts[i]:ends[i]] for each i; slices of one length are hashed together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    out = np.empty(len(starts), np.uint64)
    for size, rows in zip(sizes.tolist(), np.split(order, firsts[1:]), strict=True):
        out[rows] = _same_length(padded, words, halves, starts[rows], size, seed)
    return out


def _same_length(data: np.ndarray, words: np.ndarray, halves: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    s, done = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if size >= 32:
            lanes = [np.full(len(at), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            while done + 32 <= size:
                lanes = [_round(x, words[at + done + 8 * i]) for i, x in enumerate(lanes)]
                done += 32
            acc = sum((_rotated(x, r) for x, r in zip(lanes[1:], (7, 12, 18), strict=True)), _rotated(lanes[0], 1))
            for x in lanes:
                acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
        else:
            acc = np.full(len(at), s + P5, np.uint64)
        acc = acc + np.uint64(size)
        while done + 8 <= size:
            acc = _rotated(acc ^ _round(np.zeros_like(acc), words[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= size:
            acc = _rotated(acc ^ halves[at + done].astype(np.uint64) * P1, 23) * P2 + P3
            done += 4
        while done < size:
            acc = _rotated(acc ^ data[at + done].astype(np.uint64) * P5, 11) * P1
            done += 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))
