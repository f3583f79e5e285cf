"""Which codec a column's block takes, and how many bytes it then needs."""

from __future__ import annotations

import numpy as np

from . import pla

MOST_UNIQUE = 64
TRIAL = 256
#: Average piece lengths in the trial from which straight and cubic pieces are worth it.
LEAST_LINEAR, LEAST_CUBIC = 32, 16
HEADER_BYTES = 48


def decimal_digits(values: np.ndarray) -> int | None:
    """Fewest decimal places from 0 to 7 with which all values come back within 1e-9, relative above 1."""
    for d in range(8):
        scale = 10.0**d
        q = values * scale
        if np.abs(q).max(initial=0.0) >= 9e15:
            return None
        back = np.copysign(np.floor(np.abs(q) + 0.5), q) / scale
        if (np.abs(back - values) <= 1e-9 * np.maximum(1.0, np.abs(values))).all():
            return d
    return None


def route(values: np.ndarray, epsilon: float) -> str:
    """Run lengths for few values; else straight or cubic pieces if a trial of the first values finds them long; else decimals; else steps fine enough for epsilon; else the values."""
    values = np.asarray(values, np.float64)
    if len(values) < 2:
        return "RAW_STATS"
    if len(np.unique(values)) <= MOST_UNIQUE:
        return "RLE"
    trial = values[:TRIAL]
    bound = pla.effective_epsilon(trial, epsilon)
    lines, curves = pla.fit(trial, bound), pla.fit(trial, bound, len(trial) + 1)
    cost = {}
    if len(trial) / len(lines) >= LEAST_LINEAR:
        cost["PLA_LINEAR"] = pla.PIECE_BYTES[pla.LINEAR] * len(lines)
    if len(trial) / len(curves) >= LEAST_CUBIC:
        cost["PLA_CHEB"] = pla.PIECE_BYTES[pla.CHEB] * len(curves)
    if cost:
        return min(cost, key=cost.get)
    if decimal_digits(values) is not None:
        return "DECIMAL"
    span = float(values.max() - values.min())
    if epsilon > 0 and span / 65535 <= epsilon:
        return "QUANT16"
    return "RAW_STATS"


def holds(values: np.ndarray, codec: str, epsilon: float) -> bool:
    """Whether the codec keeps its promise for these very values."""
    span = float(values.max() - values.min()) if len(values) else 0.0
    if codec == "RLE":
        return len(np.unique(values)) <= MOST_UNIQUE
    if codec == "DECIMAL":
        return decimal_digits(values) is not None
    if codec in ("QUANT8", "QUANT16"):
        return span / ((1 << int(codec[5:])) - 1) <= epsilon
    return True


def encoded_bytes(values: np.ndarray, codec: str, pieces: list[pla.Piece] | None = None) -> int:
    """Size of the block's column in the codec's layout."""
    n = len(values)
    if codec.startswith("PLA"):
        kind = pla.CHEB if any(p[2] == pla.CHEB for p in pieces) else pla.LINEAR
        return 4 + pla.PIECE_BYTES[kind] * len(pieces) + pla.residual_bytes(pla.residuals(values, pieces))
    if codec == "RLE":
        turns = int(np.count_nonzero(np.diff(values))) + 1 if n else 0
        return 5 + 8 * len(np.unique(values)) + 3 * turns
    if codec == "DECIMAL":
        d = decimal_digits(values)
        q = np.rint(values * 10.0**d).astype(np.int64)
        top = int(np.abs(np.diff(q)).max()) * 2 if n > 1 else 0
        return HEADER_BYTES + 10 + (1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8) * max(0, n - 1)
    if codec in ("QUANT8", "QUANT16"):
        return HEADER_BYTES + 16 + n * int(codec[5:]) // 8
    return HEADER_BYTES + 8 * n
