"""Background fills of map images: dilation in occupied blocks, block growth, pull and push, colour down-sampling."""

from __future__ import annotations

import numpy as np

BACKGROUND = 128


def _shifted(a: np.ndarray, dy: int, dx: int, fill: int = 0) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def dilate(image: np.ndarray, known: np.ndarray, inside: np.ndarray, rounds: int) -> np.ndarray:
    """Unknown pixels inside occupied blocks take the rounded mean of their known neighbours, ring by ring."""
    image, known = image.astype(np.int64), known.copy()
    for _ in range(rounds):
        total, count = np.zeros_like(image), np.zeros_like(image)
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            k = _shifted(known, dy, dx, False)
            total += np.where(k, _shifted(image, dy, dx), 0)
            count += k
        new = inside & ~known & (count > 0)
        if not new.any():
            break
        image[new] = (total[new] + count[new] // 2) // count[new]
        known |= new
    return image.astype(np.uint8)


def dilate_blocks(image: np.ndarray, occupied: np.ndarray, block: int, background: int = BACKGROUND) -> np.ndarray:
    """dilate() for occupied blocks (a map of one value a block); a pixel of the background value counts as unknown."""
    inside = np.kron(occupied, np.ones((block, block), bool)).astype(bool)
    out = image.copy()
    for y, x in zip(*np.nonzero(occupied)):
        own = slice(y * block, (y + 1) * block), slice(x * block, (x + 1) * block)
        out[own] = dilate(image[own], image[own] != background, inside[own], block * block - 1)
    return out


def copy_left(image: np.ndarray, occupied: np.ndarray, block: int) -> np.ndarray:
    """Empty blocks take the pixels left of them, in the first column those above; the first block stays."""
    out = image.copy()
    rows, cols = occupied.shape
    for y in range(rows):
        for x in range(cols):
            if not occupied[y, x] and (x or y):
                own = out[y * block : (y + 1) * block, x * block : (x + 1) * block]
                own[:] = out[y * block : (y + 1) * block, x * block - 1 : x * block] if x else out[y * block - 1 : y * block, :block]
    return out


def grow_blocks(image: np.ndarray, occupancy: np.ndarray, block: int = 8) -> np.ndarray:
    """In each block with an occupied pixel, the others grow from the occupied ones; wholly empty blocks copy from the left."""
    h, w = image.shape
    occupied = occupancy.reshape(h // block, block, w // block, block).any((1, 3))
    out = image.copy()
    for y, x in zip(*np.nonzero(occupied)):
        own = slice(y * block, (y + 1) * block), slice(x * block, (x + 1) * block)
        out[own] = dilate(image[own], occupancy[own].astype(bool), np.ones((block, block), bool), 2 * block)
    return copy_left(out, occupied, block)


def pull_push(image: np.ndarray, occupancy: np.ndarray, smooth: int = 4) -> np.ndarray:
    """Unoccupied pixels from coarser means: halve until 4 pixels are left, then interpolate 144/48/48/16 and smooth."""
    value, weight = image.astype(np.int64), occupancy.astype(np.int64) * 255
    if min(value.shape) <= 4 or max(value.shape) <= 4:
        coarse = None
    else:
        pad = lambda a: np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
        v, w = pad(value), pad(weight)
        four = lambda a: (a[::2, ::2], a[1::2, ::2], a[::2, 1::2], a[1::2, 1::2])
        total = sum(four(w))
        mean = np.where(total > 0, sum(a * b for a, b in zip(four(v), four(w))) // np.maximum(total, 1), 0)
        coarse = pull_push(mean.astype(np.uint8), total > 0, min(16, smooth + 1)).astype(np.int64)
    empty = weight == 0
    if coarse is not None:
        y, x = np.indices(value.shape)
        cy, cx = y // 2, x // 2
        ny = np.clip(cy + np.where(y % 2 == 0, -1, 1), 0, coarse.shape[0] - 1)
        nx = np.clip(cx + np.where(x % 2 == 0, -1, 1), 0, coarse.shape[1] - 1)
        up = (144 * coarse[cy, cx] + 48 * coarse[ny, cx] + 48 * coarse[cy, nx] + 16 * coarse[ny, nx]) // 256
        value = np.where(empty, up, value)
        for _ in range(smooth):
            p = np.pad(value, 1, mode="edge")
            mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + 2) // 4
            value = np.where(empty, mean, value)
    elif (~empty).any():
        value = np.where(empty, int(value[~empty].mean()), value)
    return value.astype(np.uint8)
