"""Many generators of numpy, each seeded by its own number, without building each.

numpy.random.default_rng(seed) takes some 15 us, most of it spent on hashing the seed. Here
the hash (SeedSequence) and the first steps of PCG64 run over all seeds at once, and one
generator is set to each state in turn. Draws are those of default_rng, to the last bit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

_U32, _MASK = np.uint32, np.uint64(0xFFFFFFFF)
_HIGH, _LOW = np.uint64(2549297995355413924), np.uint64(4865540595714422341)


def _seeded(seeds: np.ndarray) -> np.ndarray:
    """Eight 32-bit words for each seed, as SeedSequence(seed).generate_state(8) has them."""
    pool, const = [], 0x43B0D7E5

    def mixed(v):
        nonlocal const
        v = v ^ _U32(const)
        const = const * 0x931E8875 & 0xFFFFFFFF
        v = v * _U32(const)
        return v ^ (v >> _U32(16))

    zero = np.zeros(len(seeds), _U32)
    for word in ((seeds & _MASK).astype(_U32), (seeds >> np.uint64(32)).astype(_U32), zero, zero):
        pool.append(mixed(word))
    for i in range(4):
        for j in range(4):
            if i != j:
                v = pool[j] * _U32(0xCA01F9DD) - mixed(pool[i]) * _U32(0x4973F715)
                pool[j] = v ^ (v >> _U32(16))
    out, const = [], 0x8B51F9DD
    for i in range(8):
        v = pool[i % 4] ^ _U32(const)
        const = const * 0x58F38DED & 0xFFFFFFFF
        v = v * _U32(const)
        out.append((v ^ (v >> _U32(16))).astype(np.uint64))
    return np.stack(out, 1)


def _product_high(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """The upper 64 bits of a b."""
    s = np.uint64(32)
    a1, a0, b1, b0 = a >> s, a & _MASK, b >> s, b & _MASK
    low, m, n = a0 * b0, a1 * b0, a0 * b1
    carry = ((low >> s) + (m & _MASK) + (n & _MASK)) >> s
    return a1 * b1 + (m >> s) + (n >> s) + carry


def _states(seeds: np.ndarray) -> np.ndarray:
    """PCG64's state and increment for each seed: low and high words of either."""
    w, s, one = _seeded(seeds.astype(np.uint64)), np.uint64(32), np.uint64(1)
    start_high, start_low, seq_high, seq_low = (w[:, 2 * i] | (w[:, 2 * i + 1] << s) for i in range(4))
    inc_low, inc_high = (seq_low << one) | one, (seq_high << one) | (seq_low >> np.uint64(63))
    low = inc_low + start_low
    high = inc_high + start_high + (low < inc_low)
    high = high * _LOW + low * _HIGH + _product_high(low, _LOW)
    low = low * _LOW
    total = low + inc_low
    return np.stack([total, high + inc_high + (total < low), inc_low, inc_high], 1)


def _words(bits: np.random.PCG64) -> np.ndarray | None:
    """The generator's state in memory, if it lies there as expected."""
    try:
        at = ctypes.cast(bits.ctypes.state_address, ctypes.POINTER(ctypes.c_void_p))[0]
        words = np.ctypeslib.as_array((ctypes.c_uint64 * 4).from_address(at))
        state = bits.state["state"]
        found = [state["state"] & (2**64 - 1), state["state"] >> 64, state["inc"] & (2**64 - 1), state["inc"] >> 64]
        return words if words.tolist() == found else None
    except (AttributeError, TypeError, ValueError):
        return None


def generators(seeds: np.ndarray) -> Iterator[np.random.Generator]:
    """A generator for each seed (0 to 2^63 - 1) in turn, to be used before the next is asked for. It must draw no 32-bit integers."""
    states = _states(seeds)
    bits = np.random.PCG64(0)
    rng, words = np.random.Generator(bits), _words(bits)
    for row in states:
        if words is not None:
            words[:] = row
        else:
            low, high, inc_low, inc_high = row.tolist()
            bits.state = {"bit_generator": "PCG64", "state": {"state": high << 64 | low, "inc": inc_high << 64 | inc_low}, "has_uint32": 0, "uinteger": 0}
        yield rng
