"""Filters and maps of whole pictures, vectorised: running minima, warping, shifting, painting, turning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pixels of a result that are worked out at once.
BLOCK = 1 << 18


def _running(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The minimum or maximum of the `size` (odd) values around each, along the last axis; there is nothing beyond the ends.

    After van Herk: in blocks of `size` the extremes from the left and from the right meet in each window, whatever its size: three comparisons a value.
    """
    if size < 2:
        return values
    best, none = (np.minimum, 255) if least else (np.maximum, 0)
    n, half = values.shape[-1], size // 2
    room = -(-(n + 2 * half) // size) * size
    padded = np.full((*values.shape[:-1], room), none, values.dtype)
    padded[..., half : half + n] = values
    blocks = padded.reshape(*values.shape[:-1], -1, size)
    right = best.accumulate(blocks, -1).reshape(padded.shape)
    left = best.accumulate(blocks[..., ::-1], -1)[..., ::-1].reshape(padded.shape)
    return best(left[..., :n], right[..., size - 1 : size - 1 + n])


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    """The minimum in squares of size x size pixels."""
    return _running(_running(mask, size, True).T, size, True).T


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """The maximum in squares of size x size pixels."""
    return _running(_running(mask, size, False).T, size, False).T


def denoised(mask: np.ndarray, size: int = 9) -> np.ndarray:
    """A mask of 0 and 255 without dark specks that a square of size x size pixels doesn't fit into."""
    return 255 - dilated(eroded(255 - mask, size), size)


def grown(mask: np.ndarray, pixels: int = 5) -> np.ndarray:
    """Dark lines thicker by so many pixels on every side."""
    return eroded(mask, 2 * pixels + 1)


def moved_points(points: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Points (x, y) under a 3 x 3 map."""
    x, y, w = h @ np.concatenate([points.T, np.ones((1, len(points)))])
    return np.stack([x / w, y / w], 1)


def warped(picture: np.ndarray, h: np.ndarray, width: int, height: int, outside: int = 0) -> np.ndarray:
    """The picture under a 3 x 3 map: every pixel of the result looks up where it comes from, between four pixels by their shares.

    Worked out in blocks of rows. What comes from beyond the picture is `outside`, and mixes with the pixels at its edge.
    """
    rows, columns = picture.shape[:2]
    framed = np.full((rows + 2, columns + 2, *picture.shape[2:]), outside, picture.dtype)
    framed[1:-1, 1:-1] = picture
    back, out = np.linalg.inv(h), np.empty((height, width, *picture.shape[2:]), picture.dtype)
    step = max(1, BLOCK // max(width, 1))
    for top in range(0, height, step):
        v, u = np.mgrid[top : min(height, top + step), 0:width].astype(np.float64)
        w = back[2, 0] * u + back[2, 1] * v + back[2, 2]
        w = np.where(w == 0, np.inf, w)
        # Beyond the frame all is outside; so far off that sums stay small.
        x = np.clip((back[0, 0] * u + back[0, 1] * v + back[0, 2]) / w, -1, columns) + 1
        y = np.clip((back[1, 0] * u + back[1, 1] * v + back[1, 2]) / w, -1, rows) + 1
        x0, y0 = np.minimum(x.astype(np.int64), columns), np.minimum(y.astype(np.int64), rows)
        fx, fy = x - x0, y - y0
        if picture.ndim == 3:
            fx, fy = fx[..., None], fy[..., None]
        mixed = (framed[y0, x0] * (1 - fx) + framed[y0, x0 + 1] * fx) * (1 - fy) + (framed[y0 + 1, x0] * (1 - fx) + framed[y0 + 1, x0 + 1] * fx) * fy
        out[top : top + step] = np.rint(mixed).astype(picture.dtype)
    return out


def shifted_down(picture: np.ndarray, dy: float, outside: int = 255) -> np.ndarray:
    """The picture moved down by dy rows (up by negative ones), which may be halves."""
    return warped(picture, np.array([[1, 0, 0], [0, 1, dy], [0, 0, 1.0]]), picture.shape[1], picture.shape[0], outside)


def painted(picture: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int] = (0, 255, 255)) -> np.ndarray:
    """The picture with a colour where the mask is 0."""
    return np.where((mask == 0)[..., None], np.array(colour, picture.dtype), picture)


def half_turned(picture: np.ndarray) -> np.ndarray:
    return picture[::-1, ::-1]


def tiles(picture: np.ndarray, size: int, stride: int, fill: int, whole: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(x, y, pixels) of all windows of a picture padded on the right and below: to whole windows side by side, or to where windows every `stride` cover it.

    Made one at a time; the padded picture is never there as a whole.
    """
    height, width = picture.shape[:2]
    reach = (lambda n: -(-n // size) * size) if whole else (lambda n: max(-(-(n - size) // stride), 0) * stride + size)
    for y in range(0, reach(height) - size + 1, stride):
        for x in range(0, reach(width) - size + 1, stride):
            part = picture[y : y + size, x : x + size]
            if part.shape[:2] != (size, size):
                tile = np.full((size, size, *picture.shape[2:]), fill, picture.dtype)
                tile[: part.shape[0], : part.shape[1]] = part
                part = tile
            yield x, y, part
