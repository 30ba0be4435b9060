"""Coefficients of recursive filters."""

from __future__ import annotations

import math


def butterworth(order: int, cutoff: float, rate: float, kind: str = "low") -> tuple[list[float], list[float]]:
    """(b, a) of a Butterworth filter of an order, for a cutoff frequency at a sampling rate.

    The analog prototype's poles lie evenly on the left half of the unit circle; the
    bilinear transform takes them to the sampled plane, with the cutoff where it should be.
    kind is low or high. The gain is 1 at zero frequency (low) or at half the rate (high).
    """
    warped = math.tan(math.pi * cutoff / rate)
    a, b = [1.0 + 0j], [1.0]
    for k in range(order):
        pole = complex(math.cos(math.pi * (2 * k + order + 1) / (2 * order)), math.sin(math.pi * (2 * k + order + 1) / (2 * order)))
        s = warped * pole if kind == "low" else warped / pole
        z = (1 + s) / (1 - s)
        a = [x - z * y for x, y in zip([*a, 0], [0, *a], strict=True)]
        zero = -1.0 if kind == "low" else 1.0
        b = [x - zero * y for x, y in zip([*b, 0], [0, *b], strict=True)]
    real = [x.real for x in a]
    at = 1.0 if kind == "low" else -1.0
    gain = sum(x * at**i for i, x in enumerate(real)) / sum(x * at**i for i, x in enumerate(b))
    return [x * gain for x in b], real
