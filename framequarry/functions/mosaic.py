"""Demosaicing of colour filter arrays, on whole planes or tiles held as numpy arrays."""

from __future__ import annotations

import numpy as np

# Colours of the four sites of each filter pattern, row by row.
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
#: Least and greatest gain of a channel.
GAIN_RANGE = (0.2, 5.0)


def demosaic(cfa: np.ndarray, pattern: str, dx: int = 0, dy: int = 0, inside: np.ndarray | None = None) -> np.ndarray:
    """(3, height, width): own colour kept, others the mean of the 3x3 neighbours of that colour.

    Where no neighbour has a colour, the own value stands for it. ``inside`` marks the pixels that exist (all).
    """
    h, w = cfa.shape
    y, x = (np.arange(h) + dy) % 2, (np.arange(w) + dx) % 2
    site = np.array(list(pattern)).reshape(2, 2)[y[:, None], x[None, :]]
    there = np.ones(cfa.shape, bool) if inside is None else inside
    out = np.empty((3, h, w), cfa.dtype)
    for k, colour in enumerate("RGB"):
        mine = (site == colour) & there
        value, count = (np.pad(v.astype(np.float64), 1) for v in (np.where(mine, cfa, 0), mine))
        total, n = (sum(a[i : i + h, j : j + w] for i in range(3) for j in range(3)) for a in (value, count))
        out[k] = np.where(site == colour, cfa, np.where(n > 0, total / np.maximum(n, 1), cfa))
    return out


def balanced(rgb: np.ndarray, target: int = 100_000) -> np.ndarray:
    """Planes scaled so that their medians agree, by gains within ``GAIN_RANGE``; untouched where a median is not positive."""
    flat = rgb.reshape(3, -1)
    some = np.sort(flat[:, :: max(1, flat.shape[1] // target)], 1)
    medians = some[:, some.shape[1] // 2].astype(np.float64)
    if medians.min() <= 0:
        return rgb
    return (rgb * np.clip(medians.mean() / medians, *GAIN_RANGE)[:, None, None]).astype(rgb.dtype)
