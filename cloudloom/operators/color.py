"""Colour conversion with filtered chroma: BT.709 in floats, then a horizontal and a vertical filter."""

from __future__ import annotations

import numpy as np

# BT.709 weights, and the taps of the horizontal and the vertical filter.
WEIGHTS = np.array([[0.212600, 0.715200, 0.072200], [-0.114572, -0.385428, 0.500000], [0.500000, -0.454153, -0.045847]])
HORIZONTAL = (
    -0.01716352771649, 0.0, 0.04066666714886, 0.0, -0.09154810319329, 0.0, 0.31577823859943, 0.50453345032298,
    0.31577823859943, 0.0, -0.09154810319329, 0.0, 0.04066666714886, 0.0, -0.01716352771649,
)
VERTICAL = (
    -0.00945406160902, -0.01539537217249, 0.02360533018213, 0.03519540819902, -0.05254456550808, -0.08189331229717, 0.14630826357715, 0.45417830962846,
    0.45417830962846, 0.14630826357715, -0.08189331229717, -0.05254456550808, 0.03519540819902, 0.02360533018213, -0.01539537217249, -0.00945406160902,
)


def _filtered(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Every second row or column of image, filtered; edges go on beyond the border."""
    before = (len(taps) - 1) // 2
    wide = [(0, 0), (0, 0)]
    wide[axis] = (before, len(taps) - 1 - before)
    padded = np.pad(image, wide, mode="edge").astype(np.float64)
    n = image.shape[axis]
    parts = (w * np.take(padded, np.arange(0, n - n % 2, 2) + j, axis) for j, w in enumerate(taps.astype(np.float64)))
    return (sum(parts) / 512).astype(np.float32)


def filtered_yuv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma of (height, width, 3) 8-bit pixels, and its two chroma planes at half the size."""
    yuv = rgb.astype(np.float32).astype(np.float64) / 255 @ WEIGHTS.T
    y = np.clip(yuv[..., 0], 0, 1).astype(np.float32)
    h, v = np.array(HORIZONTAL, np.float64) * 512, np.array(VERTICAL, np.float64) * 512
    half = [_filtered(_filtered(np.clip(yuv[..., c], -0.5, 0.5).astype(np.float32), h.astype(np.float32), 1), v.astype(np.float32), 0) for c in (1, 2)]
    whole = lambda x, offset: np.clip(np.floor(255.0 * x.astype(np.float64) + offset + 0.5), 0, 255).astype(np.uint8)
    return whole(y, 0), whole(half[0], 128), whole(half[1], 128)


def yuv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma of (height, width, 3) 8-bit pixels, and chroma of the mean colour of each 2 x 2 block: 32-bit floats, truncated."""
    w, c = WEIGHTS.astype(np.float32), rgb.astype(np.float32)
    weighed = lambda k, x: (w[k][0] * x[..., 0] + w[k][1] * x[..., 1]) + w[k][2] * x[..., 2]
    mean = np.float32(0.25) * (((c[::2, ::2] + c[::2, 1::2]) + c[1::2, ::2]) + c[1::2, 1::2])
    return weighed(0, c).astype(np.uint8), *((weighed(k, mean) + np.float32(128)).astype(np.uint8) for k in (1, 2))
