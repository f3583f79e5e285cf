"""Piecewise approximation of a block's values within an error bound.

A straight piece starts at its first value; each further value narrows the range
of slopes that pass within epsilon of all values so far, and where none is left a
new piece starts. Ranges are running maxima and minima over a growing stretch, so
the work is numpy's. Where a straight piece stays short, a cubic in Chebyshev form
is fitted by least squares over longer and longer stretches and taken if it covers
as much. Each piece is (start, length, kind, parameters): LINEAR slope and offset,
CHEB c0 to c3 over -1 to 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LINEAR, CHEB = "LINEAR", "CHEB"
#: Bytes of a stored piece: parameters as doubles and a 16-bit length.
PIECE_BYTES = {LINEAR: 18, CHEB: 34}
LEAST_CUBIC = 4
Piece = tuple[int, int, str, list[float]]


def effective_epsilon(values: np.ndarray, epsilon: float) -> float:
    """epsilon, or for 0 a thousandth of the range, a millionth where that is flat."""
    if epsilon > 0:
        return epsilon
    span = float(values.max() - values.min()) if len(values) else 0.0
    return 1e-6 if span < 1e-12 else 0.001 * span


def straight(values: np.ndarray, start: int, epsilon: float) -> tuple[int, float]:
    """Length and slope of the longest straight piece from `start`."""
    anchor, n = values[start], len(values) - start
    low, high, done, step = -np.inf, np.inf, 1, 32
    while done < n:
        stop = min(n, done + step)
        t = np.arange(done, stop, dtype=np.float64)
        v = values[start + done : start + stop] - anchor
        lows = np.maximum.accumulate(np.maximum((v - epsilon) / t, low))
        highs = np.minimum.accumulate(np.minimum((v + epsilon) / t, high))
        bad = np.flatnonzero(lows > highs)
        if len(bad):
            k = int(bad[0])
            if k:
                low, high = lows[k - 1], highs[k - 1]
            return done + k, _middle(low, high)
        low, high, done, step = lows[-1], highs[-1], stop, min(1024, step * 2)
    return done, _middle(low, high)


def _middle(low: float, high: float) -> float:
    return 0.0 if not np.isfinite(low + high) else float(low + (high - low) / 2)


@lru_cache(maxsize=4096)
def _basis(n: int) -> tuple[np.ndarray, np.ndarray]:
    """T0..T3 at n even places, and what turns values into least-squares coefficients."""
    b = np.polynomial.chebyshev.chebvander(np.linspace(-1.0, 1.0, n), 3)
    return b, np.linalg.pinv(b)


def cubic(values: np.ndarray, epsilon: float) -> list[float] | None:
    """Coefficients of the least-squares cubic if it stays within epsilon of all values."""
    if len(values) < LEAST_CUBIC:
        return None
    b, solve = _basis(len(values))
    c = solve @ values
    return c.tolist() if np.abs(b @ c - values).max() <= epsilon else None


def longest_cubic(values: np.ndarray, start: int, least: int, epsilon: float) -> tuple[int, list[float]] | None:
    """The longest cubic piece found by doubling, then halving the step; None below `least` values."""
    n = len(values) - start
    length = max(LEAST_CUBIC, least)
    if length > n or (best := cubic(values[start : start + length], epsilon)) is None:
        return None
    fits, fails = length, n + 1
    while fits < n and fails == n + 1:
        tried = min(n, 2 * fits)
        if (c := cubic(values[start : start + tried], epsilon)) is None:
            fails = tried
        else:
            fits, best = tried, c
    while fails - fits > 1:
        tried = (fits + fails) // 2
        if (c := cubic(values[start : start + tried], epsilon)) is None:
            fails = tried
        else:
            fits, best = tried, c
    return fits, best


def fit(values: np.ndarray, epsilon: float, cheb_below: int = 0) -> list[Piece]:
    """Pieces over all values; a straight one of fewer than `cheb_below` values makes way for a cubic that covers as many."""
    values = np.asarray(values, np.float64)
    epsilon = effective_epsilon(values, epsilon)
    out: list[Piece] = []
    at = 0
    while at < len(values):
        length, slope = straight(values, at, epsilon)
        curve = longest_cubic(values, at, length, epsilon) if length < cheb_below else None
        if curve:
            out.append((at, curve[0], CHEB, curve[1]))
            at += curve[0]
        else:
            out.append((at, length, LINEAR, [slope, float(values[at])]))
            at += length
    return out


def piece_values(piece: Piece) -> np.ndarray:
    _, length, kind, p = piece
    if kind == LINEAR:
        return p[1] + p[0] * np.arange(length)
    return np.polynomial.chebyshev.chebval(np.linspace(-1.0, 1.0, length), p) if length > 1 else np.array([p[0] - p[2]])


def decode(pieces: list[Piece]) -> np.ndarray:
    """Approximate values, each within epsilon."""
    return np.concatenate([piece_values(x) for x in pieces]) if pieces else np.empty(0)


def residuals(values: np.ndarray, pieces: list[Piece]) -> np.ndarray:
    """What is left of the values, in millionths; with it they come back within half a millionth."""
    return np.rint((np.asarray(values) - decode(pieces)) * 1e6).astype(np.int64)


def residual_bytes(r: np.ndarray) -> int:
    """Size of residuals with runs of zeros counted and the rest in the narrowest of 1 byte, 2 bytes or varints."""
    if not len(r):
        return 1
    nonzero = r[r != 0]
    turns = int(np.count_nonzero(np.diff((r == 0).astype(np.int8)) == 1) + (r[0] == 0))
    top = int(np.abs(nonzero).max()) if len(nonzero) else 0
    if top <= 127:
        return 1 + len(nonzero) + 3 * turns
    if top <= 32767:
        return 1 + 2 * len(nonzero) + 4 * turns
    bits = np.floor(np.log2(np.maximum(1, 2.0 * np.abs(nonzero)))) + 1
    return 1 + int(np.ceil(bits / 7).sum()) + 2 * turns
