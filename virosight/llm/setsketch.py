"""SetSketch registers of hashed sets, many sets at a time, and the joint likelihood estimate.

Each element of a set draws an ascending series of exponential values, one for
each register in an order of its own; a register keeps the least value it was
given, as its exponent to the base ``BASE``, truncated to 16 bits.  Registers
of a union are the larger registers of its parts, and equal registers are the
likelier the more two sets share.
"""

from __future__ import annotations

import numpy as np

from virosight.llm.text import mix

#: Registers, exponent base, rate, and the largest register.
REGISTERS, BASE, RATE, LIMIT = 128, 1.001, 20.0, (1 << 16) - 2

_LOG_BASE = np.log(BASE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(hashes: np.ndarray, owners: np.ndarray, sets: int) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of distinct element hashes; ``owners`` is each element's set.

    The rounds give every element its next value.  An element drops out when
    its value can't raise any register of its set, which after a few rounds
    holds for nearly all, so the work is about one draw an element and
    ``REGISTERS * log(REGISTERS)`` a set.
    """
    out = np.zeros(sets * REGISTERS, np.uint16)
    x = np.zeros(len(hashes))
    seed = mix(hashes.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    register = (seed & np.uint64(REGISTERS - 1)).astype(np.int64)
    stride = ((seed >> np.uint64(20)) & np.uint64(REGISTERS // 2 - 1)).astype(np.int64) * 2 + 1
    owners = owners.astype(np.int64)
    for k in range(REGISTERS):
        seed = seed + _STEP
        uniform = (mix(seed) >> np.uint64(11)).astype(np.float64)
        uniform += 0.5
        uniform *= 2.0**-53
        x = x - np.log(uniform) / (RATE * (REGISTERS - k))
        value = np.clip(np.floor(1 - np.log(x) / _LOG_BASE), 0, LIMIT + 1).astype(np.uint16)
        np.maximum.at(out, owners * REGISTERS + register, value)
        low = out.reshape(sets, REGISTERS).min(1)
        going = value > low[owners]
        if not going.any():
            break
        x, seed, register, stride, owners = x[going], seed[going], register[going], stride[going], owners[going]
        register = (register + stride) & (REGISTERS - 1)
    return out.reshape(sets, REGISTERS)


def band_hashes(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` registers, its number included."""
    parts = registers.astype(np.uint64).reshape(len(registers), -1, rows)
    total = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return total


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets with known sizes, from how many registers are larger, smaller and equal."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - golden * (high - low), low + golden * (high - low)
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2
