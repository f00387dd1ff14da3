"""Random draws that depend on whole numbers only: no row order, no partitions, the same in any engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1


def uniform(seed: int, row: str | Column, sim: str | Column) -> Column:
    """A number in [0, 1) for a row and a simulation, both whole numbers.

    A linear mix of the two is squared twice modulo a prime below 2 ** 31, so every product fits 64 bits.
    """
    r, s = (F.pmod((F.col(x) if isinstance(x, str) else x).cast("long"), F.lit(PRIME)) for x in (row, sim))
    p = F.lit(PRIME)
    mixed = (r * 48271 + s * 69621 + seed * 16807) % p
    once = (mixed * mixed + r) % p
    return ((once * once + s) % p) / F.lit(float(PRIME))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    if x.size and (x.min() < 0 or x.max() >= PRIME):
        x = np.mod(x, PRIME)
    return x.astype(np.uint64)


_BITS, _PRIME = np.uint64(31), np.uint64(PRIME)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """``x`` becomes a number with the same remainder by ``PRIME``: below 2 ** 33 + 2 ** 31 for any of 64 bits, at most 2 ** 31 + 3 for those."""
    np.right_shift(x, _BITS, out=spare)
    np.bitwise_and(x, _PRIME, out=x)
    np.add(x, spare, out=x)


def _drawn(mixed: np.ndarray, r: np.ndarray, next_sim: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``PRIME`` times the draws, plus one, in the place of ``mixed``, which is below 2 ** 32.

    The last remainder is exact: x + 1 is q * PRIME + rest + 1, and (x + 1 + (x + 1 >> 31)) >> 31 is q while q is at most
    2 ** 31 or the rest at least q - 2 ** 31. The square of a folded number above ``PRIME`` by d has q = PRIME + 2 * d and
    a rest of d * d + s, so this holds for every simulation below 2 ** 31 - 32.
    """
    x = mixed
    np.multiply(x, x, out=x)
    np.add(x, r, out=x)
    _fold(x, spare)
    _fold(x, spare)
    np.multiply(x, x, out=x)
    np.add(x, next_sim, out=x)
    np.right_shift(x, _BITS, out=spare)
    np.add(spare, x, out=spare)
    np.right_shift(spare, _BITS, out=spare)
    np.add(x, spare, out=x)
    return np.bitwise_and(x, _PRIME, out=x)


def _parts(seed: int, row: np.ndarray) -> np.ndarray:
    return (row * np.uint64(48271) + np.uint64(seed * 16807)) % _PRIME


def uniform_array(seed: int, row: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """:func:`uniform` for arrays of whole numbers, which may broadcast."""
    r, s = _reduced(row), _reduced(sim)
    x = np.atleast_1d(_parts(seed, r) + s * np.uint64(69621)) % _PRIME
    x = (x * x + r) % _PRIME
    return (x * x + s) % _PRIME / float(PRIME)


def first_draw(share: float | np.ndarray, above: bool = False) -> np.ndarray:
    """The smallest ``PRIME`` times a draw, plus one, of draws that are at least ``share``, or with ``above`` greater."""
    at = np.maximum(np.floor(np.asarray(share, np.float64) * PRIME).astype(np.int64) - 1, 0)
    for _ in range(4):
        at += (at / float(PRIME) <= share) if above else (at / float(PRIME) < share)
    return (at + 1).astype(np.uint64)


TERMS = 8  # of the product that draws are remainders of


def _nearest(x: np.ndarray) -> np.ndarray:
    """The remainder by ``PRIME`` that is nearest to zero."""
    x = (x % _PRIME).astype(np.int64)
    return np.where(x > PRIME // 2, x - PRIME, x)


def sim_terms(sims: np.ndarray) -> np.ndarray:
    """Simulations by ``TERMS``: their side of the product in :func:`shares`.

    ``PRIME`` times a draw is a polynomial of the fourth degree in b = 69621 * sim, with factors that depend on the row only. Powers
    of b are cut into 16 bits and the rest, so the factors of the rest are 2 ** 16 times those of the 16 bits.
    """
    s = _reduced(sims)
    b = s * np.uint64(69621) % _PRIME
    square = b * b % _PRIME
    terms = [np.ones(len(s)), _nearest(square * square + s)]
    for power in map(_nearest, (b, square, square * b)):
        low = (power + 2**15) % 2**16 - 2**15
        terms += [low, (power - low) >> 16]
    return np.stack(terms, axis=1).astype(np.float64)


def row_terms(seed: int, rows: np.ndarray) -> np.ndarray:
    """``TERMS`` by rows, divided by ``PRIME``: their side of the product in :func:`shares`."""
    r = _reduced(rows)
    a = _parts(seed, r)
    square = a * a % _PRIME
    c = (square + r) % _PRIME
    terms = [_nearest(c * c) + 0.5, np.ones(len(r))]
    for factor in (4 * a % _PRIME * c % _PRIME, (4 * square + 2 * c) % _PRIME, 4 * a % _PRIME):
        terms += [_nearest(factor), _nearest(factor << np.uint64(16))]
    return np.stack(terms).astype(np.float64) / PRIME


def shares(by_sim: np.ndarray, by_row: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Draws of simulations by rows, each with half a step of 1 / ``PRIME`` added: one matrix product and its fraction.

    The product is below 2 ** 17 and all its roundings together below 2 ** -33.6, in any order. A draw is a whole number of steps
    and half a step is 2 ** -32, so no share lies on the wrong side of a step.
    """
    np.dot(by_sim, by_row, out=out)
    np.floor(out, out=spare)
    return np.subtract(out, spare, out=out)


def places(share: np.ndarray, size: int) -> np.ndarray:
    """In the place of ``share``: what rounded down is the draw times ``size``, for up to 2 ** 16."""
    if size == 1024:  # no multiple of 2 ** 21 lies between x * 2 ** 31 / PRIME and x
        return np.multiply(share, PRIME / 2**21, out=share)
    np.multiply(share, PRIME, out=share)
    np.floor(share, out=share)  # PRIME times the draw
    np.multiply(share, size, out=share)
    np.add(share, 0.5, out=share)  # the fraction is a whole number of steps, too
    return np.divide(share, PRIME, out=share)


class Grid:
    """Draws of a few rows by many simulations, in buffers small enough for a processor's cache."""

    def __init__(self, sims: np.ndarray, rows: int) -> None:
        self.sims = sims
        s = _reduced(sims)
        self._s, self._next = s * np.uint64(69621) % _PRIME, s + np.uint64(1)
        self._shape = rows, len(sims)
        self._held: dict[object, np.ndarray] = {}

    def at(self, rows: np.ndarray) -> None:
        """The rows that the next draws are of."""
        self._rows = _reduced(rows)[:, None]

    def buffer(self, name: object, kind: type) -> np.ndarray:
        """An array of the grid's shape for any use; the next call with the same name gets it again."""
        if name not in self._held:
            self._held[name] = np.empty(self._shape, kind)
        return self._held[name][: len(self._rows)]

    def whole(self, seed: int) -> np.ndarray:
        """``PRIME`` times the draws, plus one, until the next call."""
        x = np.add(_parts(seed, self._rows), self._s, out=self.buffer("x", np.uint64))
        return _drawn(x, self._rows, self._next, self.buffer("spare", np.uint64))

    def floats(self, seed: int) -> np.ndarray:
        """:meth:`whole` as floats, until the next call with the same seed."""
        out = self.buffer(seed, np.float64)
        np.copyto(out, self.whole(seed).view(np.int64))
        return out

    def reach(self, seed: int, first: np.ndarray) -> np.ndarray:
        """Which draws are at least ``first``, a number from :func:`first_draw`, until the next call with the same seed."""
        return np.greater_equal(self.whole(seed), first, out=self.buffer((seed, "reach"), bool))

    def picks(self, seed: int, size: int) -> np.ndarray:
        """The draws times ``size``, rounded down, until the next call of any draw."""
        x = self.whole(seed)
        np.subtract(x, np.uint64(1), out=x)
        if size == 1024:  # no multiple of 2 ** 21 lies between x * 2 ** 31 / PRIME and x
            return np.right_shift(x, np.uint64(21), out=x).view(np.int64)
        spare = self.buffer("spare", np.uint64)
        np.multiply(x, np.uint64(size), out=x)
        np.right_shift(x, _BITS, out=spare)
        np.add(x, spare, out=x)
        np.add(x, np.uint64(1), out=x)
        return np.right_shift(x, _BITS, out=x).view(np.int64)
