"""Smoothing kernels as lists of (offset in bins, weight); weights sum to 1.

Offset k says that a point k bins before (k > 0) or after (k < 0) an output bin counts
for it, so causal kernels have no negative offsets.
"""

from __future__ import annotations

import math

Taps = list[tuple[int, float]]


def _normal(raw: Taps) -> Taps:
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw if w]


def gaussian(sigma: float = 20.0, width: float = 1.0, reach: float = 3.0, delay: float = 0.0, causal: bool = False) -> Taps:
    """The bell around delay; causal cuts off what acts on points to come."""
    n, shift = math.ceil(reach * sigma / width), round(delay / width)
    return _normal([(k + shift, math.exp(-0.5 * (k * width / sigma) ** 2)) for k in range(-n, n + 1) if k + shift >= 0 or not causal])


def identity() -> Taps:
    return [(0, 1.0)]


def half_gaussian(sigma: float = 20.0, width: float = 1.0, reach: float = 3.0) -> Taps:
    return _normal([(k, w) for k, w in gaussian(sigma, width, reach) if k >= 0])


def exponential(tau: float = 25.0, width: float = 1.0, reach: float = 4.0) -> Taps:
    n = math.ceil(reach * tau / width)
    return _normal([(k, math.exp(-k * width / tau)) for k in range(n + 1)])


def growth_decay(growth: float = 1.0, decay: float = 20.0, width: float = 1.0, reach: float = 4.0) -> Taps:
    n = math.ceil(reach * decay / width)
    return _normal([(k, (1 - math.exp(-k * width / growth)) * math.exp(-k * width / decay)) for k in range(n + 1)])


def boxcar(bins: int) -> Taps:
    return _normal([(k, 1.0) for k in range(bins)])


def lowpass(up: int, down: int, half: int = 10, beta: float = 5.0) -> Taps:
    """Taps on a grid up times finer of a low pass that keeps what both rates, the series' own and
    up / down times that, can hold: half zero crossings of a sinc to each side under a Kaiser window."""
    import numpy as np

    wide = max(up, down)
    n = half * wide
    k = np.arange(-n, n + 1)
    w = np.sinc(k / wide) * np.i0(beta * np.sqrt(1 - (k / n) ** 2)) / np.i0(beta)
    return _normal([(int(i), float(x)) for i, x in zip(k, w, strict=True)])


def savitzky_golay(frame: int = 5, degree: int = 2, order: int = 1, width: float = 1.0, at: int = 0) -> Taps:
    """Taps of the derivative of the given order of a polynomial fitted to an odd frame, at that many
    samples from the frame's middle."""
    import numpy as np

    half = frame // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    powers = [math.perm(p, order) * float(at) ** (p - order) if p >= order else 0.0 for p in range(degree + 1)]
    weights = np.array(powers) @ fit / width**order
    return [(-int(k), float(w)) for k, w in zip(x, weights, strict=True)]
