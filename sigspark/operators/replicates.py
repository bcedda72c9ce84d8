"""Random weights and labels of groups, computed in the task that needs them from (seed, group number, replicate).

No table of draws exists: a task asks for the groups it holds, REPLICATES_AT_ONCE replicates at a time, and every task gets
the same answer. Groups are known by their 0-based number, see ``resampling.pure_numbered_groups``.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 4096                            # groups whose draws are made together
REPLICATES_AT_ONCE = 64
PRIME = 2147483647
MAX_ROTATED = 1 << 24                   # groups of a rotation, one or two bytes each in every task


def picks(rep: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Pseudo-random group position for each slot of a replicate; integer arithmetic any SQL engine can repeat.

    Every product stays below 2^63, so no count of groups or replicates overflows; replicate and slot (its low and its high
    part) are mixed one after the other, so picks do not repeat from replicate to replicate.
    """
    r = (rep % PRIME + 1) * 69621 % PRIME
    h = ((slot % PRIME + 1) * 48271 + slot // PRIME * 40692 % PRIME + r) % PRIME
    a = h * (h + 16807) % PRIME
    b = a * ((a + r) % PRIME) % PRIME
    c = b * (b + 12345) % PRIME
    return (c * PRIME + b) % n


def _below_prime(x: np.ndarray, spare: np.ndarray) -> None:
    """x, less than twice PRIME, modulo PRIME, in place: the wrapped difference is the larger one where x is below."""
    np.minimum(x, np.subtract(x, np.uint64(PRIME), out=spare), out=x)


def _folded(x: np.ndarray, spare: np.ndarray) -> None:
    """x, less than 2^62, modulo PRIME, in place: PRIME is 2^31 - 1, so high bits are added to low ones without a division."""
    for _ in range(2):
        np.right_shift(x, np.uint64(31), out=spare)
        x &= np.uint64(PRIME)
        x += spare
    _below_prime(x, spare)


def block_picks(reps: np.ndarray, first: int, n_slots: int, n: int) -> np.ndarray:
    """(replicate, slot): ``picks`` of the slots from ``first`` on, in strips that stay in the processor's cache."""
    slot = np.arange(first, first + n_slots)
    base = (((slot % PRIME + 1) * 48271 + slot // PRIME * 40692 % PRIME) % PRIME).astype(np.uint64)
    turn = ((reps % PRIME + 1) * 69621 % PRIME).astype(np.uint64)[:, None]
    out = np.empty((len(reps), n_slots), dtype=np.int64)
    for i in range(0, len(reps), 8):
        r = turn[i:i + 8]
        h = base + r
        spare = np.empty_like(h)
        _below_prime(h, spare)
        a = h + np.uint64(16807)
        a *= h
        _folded(a, spare)
        np.add(a, r, out=h)
        _below_prime(h, spare)
        h *= a
        _folded(h, spare)
        np.add(h, np.uint64(12345), out=a)
        a *= h
        _folded(a, spare)
        a *= np.uint64(PRIME)
        a += h
        out[i:i + 8] = a & np.uint64(n - 1) if n & (n - 1) == 0 else a % np.uint64(n)
    return out


def chunks(n_replicates: int) -> list[np.ndarray]:
    return [np.arange(at, min(at + REPLICATES_AT_ONCE, n_replicates)) for at in range(0, n_replicates, REPLICATES_AT_ONCE)]


@dataclass(frozen=True)
class GroupDraws:
    """As many draws with replacement as there are groups, anew for each replicate.

    Draws are dealt down a binary tree over blocks of BLOCK groups, each node splitting its draws by a binomial number that
    depends on (seed, node, replicates) alone, and then picked inside a block. That is a multinomial draw over all groups,
    of which a task makes only the blocks it holds; up to BLOCK groups there is one block and nothing to split.
    """

    n_groups: int
    n_replicates: int
    seed: int = 0

    def _per_block(self, wanted: np.ndarray, reps: np.ndarray) -> np.ndarray:
        """(block, replicate): draws that fall into each wanted block; ``wanted`` is sorted."""
        out = np.empty((len(wanted), len(reps)), dtype=np.int64)
        blocks = -(-self.n_groups // BLOCK)
        todo = [(0, blocks, 0, len(wanted), np.full(len(reps), self.n_groups, dtype=np.int64))]
        while todo:
            lo, hi, first, last, n = todo.pop()
            if first == last:
                continue
            if hi - lo == 1:
                out[first] = n
                continue
            mid, cut = (lo + hi) // 2, first + int(np.searchsorted(wanted[first:last], (lo + hi) // 2))
            size, left = min(hi * BLOCK, self.n_groups) - lo * BLOCK, (mid - lo) * BLOCK
            dice = np.random.Generator(np.random.Philox(key=np.array([self.seed, lo << 32 | hi], dtype=np.uint64), counter=[0, 0, 0, int(reps[0])]))
            k = dice.binomial(n, left / size)
            todo += [(lo, mid, first, cut, k), (mid, hi, cut, last, n - k)]
        return out

    def weights(self, groups: np.ndarray, reps: np.ndarray, kind: type = np.float64) -> np.ndarray:
        """(group, replicate): how often each of the sorted distinct ``groups`` is drawn; ``reps`` is one of ``chunks``."""
        out = np.empty((len(groups), len(reps)), dtype=kind)
        wanted, starts = np.unique(groups // BLOCK, return_index=True)
        ends, mixed = np.append(starts[1:], len(groups)), reps + self.seed * 1_000_003
        for block, lo, hi, n in zip(wanted.tolist(), starts, ends, self._per_block(wanted, reps)):
            size = min(BLOCK, self.n_groups - block * BLOCK)
            picked, w = block_picks(mixed, block << 32, int(n.max()), size), np.empty((len(reps), size), dtype=kind)
            for row, drawn, k in zip(w, picked, n.tolist()):
                row[:] = np.bincount(drawn[:k], minlength=size)
            out[lo:hi] = (w if hi - lo == size else w[:, groups[lo:hi] - block * BLOCK]).T
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class GroupShuffles:
    """The groups' own labels dealt to them anew in each replicate; ``sizes`` are the groups of each class.

    A replicate permutes group numbers by a keyed Feistel network on a grid of a * b >= n places, walking on where a place
    lies outside; the place a group comes to names its class. So each class keeps its number of groups exactly.
    """

    sizes: tuple[int, ...]
    n_replicates: int
    seed: int = 0
    rounds: int = 8

    def places(self, groups: np.ndarray, reps: np.ndarray) -> np.ndarray:
        n = sum(self.sizes)
        a = max(1, int(np.ceil(np.sqrt(n))))
        b = -(-n // a)
        key = _mix(np.full(len(reps), self.seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + reps.astype(np.uint64))
        x = np.repeat(groups[:, None], len(reps), axis=1).ravel()
        keys, out = np.tile(key, len(groups)), np.arange(x.size)
        result = np.empty(x.size, dtype=np.int64)
        while out.size:
            left, right = x // b, x % b
            for i in range(self.rounds):
                half, size = (right, a) if i % 2 == 0 else (left, b)
                turn = (_mix(half.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys + np.uint64(i + 1)) % np.uint64(size)).astype(np.int64)
                if i % 2 == 0:
                    left = (left + turn) % a
                else:
                    right = (right + turn) % b
            x = left * b + right
            inside = x < n
            result[out[inside]] = x[inside]
            x, keys, out = x[~inside], keys[~inside], out[~inside]
        return result.reshape(len(groups), len(reps))

    def codes(self, groups: np.ndarray, reps: np.ndarray) -> np.ndarray:
        """(group, replicate): class dealt to each group."""
        return np.searchsorted(np.cumsum(self.sizes), self.places(groups, reps), side="right")


@dataclass(frozen=True)
class Rotations:
    """The sorted list of group labels moved on by (replicate + 1) * step; of n groups there are n rotations, so it is for
    small numbers of groups and refuses more than MAX_ROTATED."""

    labels: np.ndarray
    n_replicates: int
    step: int = 1

    def __post_init__(self):
        if len(self.labels) > MAX_ROTATED:
            raise ValueError(f"rotations take at most {MAX_ROTATED} groups; use GroupShuffles")

    def codes(self, groups: np.ndarray, reps: np.ndarray) -> np.ndarray:
        return self.labels[(groups[:, None] - (reps[None, :] + 1) * self.step) % len(self.labels)]
