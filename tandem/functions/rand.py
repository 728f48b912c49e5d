"""Deterministic randomness from hashes.

A draw depends only on its text key, so results do not change with
partitioning, retries or engine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0
WORD = np.uint64(0xFFFFFFFF)


def hash32(key: Column) -> Column:
    """First 32 bits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash60(key: Column) -> Column:
    """60 bits of md5 as a bigint: a row key for ids that are text."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def hash01(key: Column) -> Column:
    """Uniform in [0, 1)."""
    return hash32(key) / F.lit(TWO32)


def seeded(seed, *parts) -> Column:
    """The text ``seed:part:part`` used as a hash key."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 32-bit words held in 64 bits; SQL can state the same products."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & WORD
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & WORD
    return x ^ (x >> np.uint64(16))


def key_words(keys, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit words per cell, from one md5 of seed and key."""
    raw = b"".join(hashlib.md5(f"{seed}:{k}".encode()).digest()[:8] for k in keys)
    both = np.frombuffer(raw, dtype=">u4").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def uniforms(words: tuple[np.ndarray, np.ndarray], n_boot: int, part: int) -> np.ndarray:
    """Uniforms of 53 bits, (cells, n_boot): a counter (replicate, part) mixed into each cell's words."""
    counter = _mixed((np.arange(n_boot, dtype=np.uint64) * np.uint64(64) + np.uint64(part + 1)) & WORD)
    high = _mixed(words[0][:, None] ^ counter[None, :])
    low = _mixed(high ^ words[1][:, None])
    return (high * np.uint64(1 << 21) + (low >> np.uint64(11))).astype(np.float64) / float(1 << 53)


@lru_cache(maxsize=64)
def poisson_table(power: int) -> tuple[int, np.ndarray]:
    """(first count, cumulative probabilities) of Poisson(2^power), all that doubles can tell from 0 and 1."""
    lam = float(1 << power)
    reach = 12.0 * math.sqrt(lam) + 40.0
    first = max(0, math.floor(lam - reach))
    counts = np.arange(first, math.floor(lam + reach) + 1)
    logs = counts * math.log(lam) - lam - np.array([math.lgamma(n + 1.0) for n in counts])
    return first, np.cumsum(np.exp(logs))


LOOK_BITS = 14  # leading bits of a uniform that tell almost every Poisson count
_BLOCK = 1 << 16  # words mixed at once, so that they stay in the processor's cache


@lru_cache(maxsize=64)
def poisson_lookup(power: int) -> np.ndarray:
    """Count by the leading bits of the uniform, -1 where those bits leave more than one open."""
    first, steps = poisson_table(power)
    edges = np.arange((1 << LOOK_BITS) + 1) / float(1 << LOOK_BITS)
    low = np.searchsorted(steps, edges[:-1], side="right")
    high = np.searchsorted(steps, edges[1:] - 1.0 / (1 << 53), side="right")
    return np.where(low == high, first + low, -1).astype(np.float64)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """``_mixed`` in place on 32-bit words, whose products wrap by themselves."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def _poisson_draws(words: tuple[np.ndarray, np.ndarray], n_boot: int, power: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(cells, their Poisson(2^power) counts) block by block; the same counts as from ``uniforms`` and ``poisson_table``.

    The leading bits of the first word settle a count unless a step of the
    distribution lies inside their range; only there the whole uniform is made.
    """
    counter = _mixed((np.arange(n_boot, dtype=np.uint64) * np.uint64(64) + np.uint64(power + 1)) & WORD).astype(np.uint32)
    high, low = (w.astype(np.uint32) for w in words)
    look, (first, steps) = poisson_lookup(power), poisson_table(power)
    step = max(1, _BLOCK // n_boot)
    for a in range(0, len(high), step):
        x = high[a : a + step, None] ^ counter[None, :]
        spare = np.empty_like(x)
        _mix(x, spare)
        np.right_shift(x, np.uint32(32 - LOOK_BITS), out=spare)
        got = look[spare.astype(np.intp)]
        unclear = np.flatnonzero(got < 0)
        if len(unclear):
            i, b = np.divmod(unclear, n_boot)
            top = x[i, b].astype(np.uint64)
            rest = _mixed(top ^ low[a : a + step][i].astype(np.uint64))
            u = (top * np.uint64(1 << 21) + (rest >> np.uint64(11))).astype(np.float64) / float(1 << 53)
            got[i, b] = first + np.searchsorted(steps, u, side="right")
        yield slice(a, a + len(x)), got


def poisson_weights(keys, counts, n_boot: int, seed: int) -> np.ndarray:
    """Resampling weight of each cell in each replicate: Poisson(count of the cell), exact for every count.

    A count is the sum of its binary digits, and a Poisson number of a sum is
    the sum of Poisson numbers: one inverted uniform per digit that is set, so
    the cost grows with the digits of a count and not with the count.
    """
    counts = np.asarray(counts, dtype=np.int64)
    words = key_words(keys, seed)
    out = np.empty((len(counts), n_boot))
    fresh = np.ones(len(counts), dtype=bool)
    for power in range(int(counts.max(initial=0)).bit_length()):
        at = np.flatnonzero(counts >> power & 1)
        for cells, got in _poisson_draws((words[0][at], words[1][at]), n_boot, power):
            own = at[cells]
            if fresh[own].all():
                out[own] = got
            else:
                got += np.where(fresh[own, None], 0.0, out[own])
                out[own] = got
            fresh[own] = False
    out[fresh] = 0.0
    return out


def uniforms_at(high: np.ndarray, low: np.ndarray, b: np.ndarray, part: int) -> np.ndarray:
    """``uniforms`` of single (words, replicate) pairs."""
    counter = _mixed((b.astype(np.uint64) * np.uint64(64) + np.uint64(part + 1)) & WORD)
    high = _mixed(high ^ counter)
    low = _mixed(high ^ low)
    return (high * np.uint64(1 << 21) + (low >> np.uint64(11))).astype(np.float64) / float(1 << 53)


@lru_cache(maxsize=512)
def binomial_table(power: int, left: int, total: int) -> tuple[int, np.ndarray]:
    """(first count, cumulative probabilities) of Binomial(2^power, left / total), all that doubles can tell from 0 and 1."""
    n, p = 1 << power, left / total
    reach = 12.0 * math.sqrt(n * p * (1.0 - p)) + 40.0
    first = max(0, math.floor(n * p - reach))
    counts = range(first, min(n, math.floor(n * p + reach)) + 1)
    logs = [
        math.lgamma(n + 1.0) - math.lgamma(k + 1.0) - math.lgamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log(1.0 - p)
        for k in counts
    ]
    return first, np.cumsum(np.exp(logs))


def _split(drawn: np.ndarray, left: np.ndarray, total: np.ndarray, keys: list[str], seed: int, replicate: int) -> np.ndarray:
    """Of the draws that fall into each node (nodes x replicates), those of its left part, by binary digits as in poisson_weights."""
    out = np.where((left == total)[:, None], drawn, 0)
    words = key_words(keys, seed)
    for share in np.unique(np.stack([left, total], 1)[left < total] // np.gcd(left, total)[left < total, None], axis=0).tolist():
        own = np.flatnonzero((left < total) & (left * share[1] == total * share[0]))
        counts = drawn[own]
        for power in range(int(counts.max(initial=0)).bit_length()):
            i, b = np.nonzero(counts >> power & 1)
            if len(i):
                first, steps = binomial_table(power, *share)
                u = uniforms_at(words[0][own[i]], words[1][own[i]], b + replicate, power)
                out[own[i], b] += first + np.searchsorted(steps, u, side="right")
    return out


def multinomial_weights(stratum: str, size: int, start: np.ndarray, end: np.ndarray, n_boot: int, seed: int, replicate: int = 0) -> np.ndarray:
    """How often ``size`` draws with replacement from ``size`` rows hit rows [start, end), for every replicate from ``replicate`` on: exact.

    The rows are the leaves of a binary tree; the draws of a node fall to its
    left part binomially, by a number that hangs on (seed, stratum, node,
    replicate) alone. So any task can tell the draws of its own rows, and all
    tasks together draw ``size``. Only nodes with a given bound inside are split.
    """
    bounds, place = np.unique(np.concatenate([start, end]), return_inverse=True)
    before = np.zeros((len(bounds), n_boot), np.int64)
    before[bounds >= size] = size
    live = np.flatnonzero((bounds > 0) & (bounds < size))
    nodes, drawn = np.zeros(1, np.int64), np.full((1, n_boot), size, np.int64)
    for power in range(max(size - 1, 0).bit_length(), 0, -1):
        live = live[bounds[live] & ((1 << power) - 1) != 0]
        if not len(live):
            break
        asked = bounds[live] >> power
        own = np.unique(asked)
        if power < max(size - 1, 0).bit_length():
            at = np.searchsorted(nodes, own >> 1)
            drawn = np.where((own & 1 == 1)[:, None], drawn[at] - gone[at], gone[at])
        nodes = own
        total = np.minimum(size - (nodes << power), 1 << power)
        left = np.minimum(total, 1 << (power - 1))
        gone = _split(drawn, left, total, [f"{stratum}:{power}:{n}" for n in nodes.tolist()], seed, replicate)
        right = bounds[live] >> (power - 1) & 1 == 1
        before[live[right]] += gone[np.searchsorted(nodes, asked[right])]
    first, last = place[: len(start)], place[len(start) :]
    return before[last] - before[first]
