"""Outlines of a mask's parts: run-based labelling with union-find, features of all parts at once, border following, simplification; boxes that run together.

A mask is a height x width array of truth values. Parts are 8-connected; only outermost ones count, with what they enclose, so
that a part inside another's hole belongs to that other one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from boxmill.functions.pixels import ordered_corners

#: Pairs of boxes that are looked at at once, and pixels of a picture that crowded boxes are painted on.
PAIRS, PIXELS = 1 << 20, 1 << 22
#: The eight neighbours, clockwise from the left one, as steps in y and x.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


class Parts(NamedTuple):
    """Parts by their first pixels, from the bottom up: the lowest and rightmost one is the first.

    area is that inside the polygon through the centres of the border's pixels; x, y, w, h the bounding box; mean that of the values of all pixels, enclosed ones too.
    """

    area: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    mean: np.ndarray
    start: np.ndarray


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true pixels, as places in the flat picture; no run goes on in the next row."""
    edges = np.zeros((mask.shape[0], mask.shape[1] + 1), bool)
    edges[:, :-1] = mask
    flat = edges.ravel()
    # Starts and ends take turns, as every row ends with an empty column.
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    turns = np.append(0, turns) if len(flat) and flat[0] else turns
    # A place in the picture with one more column, without the columns before it.
    back = lambda at: at - at // edges.shape[1]
    return back(turns[::2]), back(turns[1::2] - 1) + 1


def _labels(starts: np.ndarray, ends: np.ndarray, width: int, reach: int) -> np.ndarray:
    """For each run the first run that it is connected with; runs of neighbouring rows touch if they are `reach` columns apart at most (0: straight, 1: over corners)."""
    n = len(starts)
    # In the row above, the runs that end behind this one's start and start before its end.
    first = np.searchsorted(ends, starts - width - reach, "right")
    last = np.searchsorted(starts, ends - width + reach, "left")
    # Not what is near in the flat picture but in another row.
    row = starts // width
    first, last = np.maximum(first, np.searchsorted(row, row - 1)), np.minimum(last, np.searchsorted(row, row))
    count = np.maximum(last - first, 0)
    b = np.repeat(np.arange(n), count)
    a = np.repeat(first, count) + np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
    return _united(np.arange(n), a, b)


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first node that each is connected with, by parent (such first nodes) and the pairs a, b."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with all that its parts enclose: what the outer background (connected straight, not over corners) doesn't reach."""
    height, width = mask.shape
    ground = np.ones((height + 2, width + 2), bool)
    ground[1:-1, 1:-1] = ~mask
    starts, ends = _runs(ground)
    outer = _labels(starts, ends, width + 2, 0) == 0
    steps = np.zeros(ground.size + 1, np.int8)
    steps[starts[outer]] += 1
    steps[ends[outer]] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).reshape(ground.shape)[1:-1, 1:-1] == 0


def parts(mask: np.ndarray, values: np.ndarray | None = None) -> Parts:
    """All outermost parts of a mask. values: what is averaged, 0 without it."""
    whole = filled(mask)
    height, width = whole.shape
    starts, ends = _runs(whole)
    roots, part = np.unique(_labels(starts, ends, width, 1), return_inverse=True)
    n = len(roots)
    size = np.bincount(part, ends - starts, n)
    total = np.zeros(n)
    if values is not None and n:
        turns = np.stack([starts, ends], 1).ravel()
        turns = turns[:-1] if turns[-1] == values.size else turns
        total = np.bincount(part, np.add.reduceat(values.ravel(), turns, dtype=np.float64)[::2], n)
    left, right, top, bottom = np.full(n, width), np.zeros(n, np.int64), np.full(n, height), np.zeros(n, np.int64)
    for of, ufunc, at in ((left, np.minimum, starts % width), (right, np.maximum, (ends - 1) % width), (top, np.minimum, starts // width), (bottom, np.maximum, starts // width)):
        ufunc.at(of, part, at)
    # Of every four pixels that meet in a corner, four of a part are a unit of its area and three are half of one.
    area = np.zeros(n)
    if height > 1 and width > 1 and n:
        own = np.zeros(whole.size, np.int32)
        own[starts] = part + 1
        length = ends - starts
        own[whole.ravel()] = np.repeat(part + 1, length)
        own = own.reshape(whole.shape)
        inside = whole.view(np.uint8)
        quads = inside[:-1, :-1] + inside[:-1, 1:] + inside[1:, :-1] + inside[1:, 1:]
        corners = (own[:-1, :-1], own[:-1, 1:], own[1:, :-1], own[1:, 1:])
        three = quads == 3
        label = np.maximum.reduce([c[three] for c in corners])
        area = (np.bincount(corners[0][quads == 4], minlength=n + 1) + np.bincount(label, minlength=n + 1) / 2)[1:]
    mean = total / np.maximum(size, 1)
    return Parts(*(a[::-1] for a in (area, left, top, right - left + 1, bottom - top + 1, mean, starts[roots])))


def _first_of_pixels(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """For each box (x1, y1, x2, y2) of a picture, with pixels of its own, the first box that its pixels run together with: painted, whatever the number of boxes."""
    x1, x2, y1, y2 = x1 - x1.min(), x2 - x1.min(), y1 - y1.min(), y2 - y1.min()
    steps = np.zeros((y2.max() + 1, x2.max() + 1), np.int64)
    for x, y, by in ((x1, y1, 1), (x2, y1, -1), (x1, y2, -1), (x2, y2, 1)):
        np.add.at(steps, (y, x), by)
    mask = steps.cumsum(0).cumsum(1) > 0
    starts, ends = _runs(mask)
    label = _labels(starts, ends, mask.shape[1], 1)[np.searchsorted(starts, y1 * mask.shape[1] + x1, "right") - 1]
    _, first, part = np.unique(label, return_index=True, return_inverse=True)
    return first[part]


def boxes_together(image: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, ...]:
    """What boxes of whole numbers run together when they are painted: (k, x, y, w, h) of each part, where k is the place of one of its boxes.

    image are the boxes' images as ascending whole numbers. Boxes touch where their edges or corners meet. A part that another one encloses is a part of its own. Boxes without
    pixels touch too; one with an end before its start is no part by itself.

    Of an image's boxes, sorted from the left, those pairs are looked at that share a column, block by block. Where these are more than the image's pixels the boxes are painted instead.
    """
    n = len(image)
    order = np.lexsort((x1, image))
    image, x1, y1, x2, y2 = (c[order] for c in (image, x1, y1, x2, y2))
    values, ranks = np.unique(np.concatenate([x1, x2]), return_inverse=True)
    place = image.astype(np.int64) * len(values)
    count = np.maximum(np.searchsorted(place + ranks[:n], place + ranks[n:], "right") - np.arange(1, n + 1), 0)
    parent, alone = np.arange(n), (x1 > x2) | (y1 > y2)

    cuts = np.flatnonzero(np.diff(image, prepend=image[:1] - 1))
    of_image = lambda ufunc, by: ufunc.reduceat(by, cuts).astype(float) if n else by
    pixels = (of_image(np.maximum, x2) - of_image(np.minimum, x1) + 1) * (of_image(np.maximum, y2) - of_image(np.minimum, y1) + 1)
    crowded = (pixels <= np.minimum(PIXELS, of_image(np.add, count))) & (of_image(np.minimum, np.minimum(x2 - x1, y2 - y1)) > 0)
    for k in np.flatnonzero(crowded):
        own = slice(cuts[k], cuts[k + 1] if k + 1 < len(cuts) else n)
        parent[own] = cuts[k] + _first_of_pixels(x1[own], y1[own], x2[own], y2[own])
        count[own] = 0

    before = np.cumsum(count) - count
    blocks = np.flatnonzero(np.diff(before // PAIRS, prepend=-1))
    for low, high in zip(blocks, np.append(blocks[1:], n)):
        c = count[low:high]
        a = np.repeat(np.arange(low, high), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(before[low:high] - before[low], c)
        met = (x1[a] <= x2[b]) & (y1[a] <= y2[b]) & (y1[b] <= y2[a])
        a, b = a[met], b[met]
        parent = _united(parent, a, b)
        alone[a] = alone[b] = False

    kept = np.flatnonzero(~alone)
    roots, part = np.unique(parent[kept], return_inverse=True)
    left, top, right, bottom = x1[roots], y1[roots], x2[roots], y2[roots]
    for of, ufunc, by in ((left, np.minimum, x1), (top, np.minimum, y1), (right, np.maximum, x2), (bottom, np.maximum, y2)):
        ufunc.at(of, part, by[kept])
    return order[roots], left, top, right - left, bottom - top


def border(whole: np.ndarray, start: int) -> np.ndarray:
    """The outer border of the part whose first pixel is at `start` in the flat picture, as points (x, y); of straight stretches only the ends."""
    height, width = whole.shape
    framed = np.zeros((height + 2, width + 2), np.uint8)
    framed[1:-1, 1:-1] = whole
    inside, wide = framed.tobytes(), width + 2
    steps = [dy * wide + dx for dy, dx in _AROUND]
    first = (start // width + 1) * wide + start % width + 1
    found = next((k for k in range(8) if inside[first + steps[k]]), None)
    if found is None:
        return np.array([[start % width, start // width]])
    here, back, chain = first, found, []
    while True:
        # Against the clock from the pixel that was left last, to the next pixel of the part.
        to = (back - 1) & 7
        while not inside[here + steps[to]]:
            to = (to - 1) & 7
        after = here + steps[to]
        chain.append((here, to))
        if after == first and here == first + steps[found]:
            break
        here, back = after, (to + 4) & 7
    turns = [at for k, (at, to) in enumerate(chain) if chain[k - 1][1] != to] or [first]
    at = np.array(turns)
    return np.stack([at % wide - 1, at // wide - 1], 1)


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(points - np.roll(points, -1, 0)).T).sum())


def _far(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances from the line through a and b, or from a where they are one point."""
    (dx, dy), (px, py) = b - a, (points - a).T
    length = np.hypot(dx, dy)
    return np.hypot(px, py) if not length else np.abs(px * dy - py * dx) / length


def simplified(points: np.ndarray, epsilon: float) -> np.ndarray:
    """The corners of a closed outline after Douglas and Peucker: no point is farther than epsilon from the line between the corners around it.

    It is split where it is widest; of the two ends of that split one that is near the line between its neighbours goes.
    """
    n = len(points)
    if n < 3:
        return points
    distance = lambda k: np.hypot(*(points - points[k]).T)
    a = int(distance(0).argmax())
    b = int(distance(a).argmax())
    ring = np.roll(points, -min(a, b), 0).astype(float)
    ring = np.concatenate([ring, ring[:1]])
    kept, todo = {0, abs(a - b)}, [(0, abs(a - b)), (abs(a - b), n)]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        far = _far(ring[low + 1 : high], ring[low], ring[high])
        k = int(far.argmax())
        if far[k] > epsilon:
            kept.add(low + 1 + k)
            todo += [(low, low + 1 + k), (low + 1 + k, high)]
    corners = sorted(kept)
    for end in (0, abs(a - b)):
        k = corners.index(end) if end in corners else -1
        if k >= 0 and len(corners) > 2 and _far(ring[end][None], ring[corners[k - 1]], ring[corners[(k + 1) % len(corners)]])[0] <= epsilon:
            del corners[k]
    return ring[corners].astype(points.dtype)


def largest_outline(mask: np.ndarray) -> np.ndarray:
    """The outline of the largest part by area, of equal ones the first; no points for an empty mask."""
    found = parts(mask)
    if not len(found.area):
        return np.zeros((0, 2), np.int64)
    return border(filled(mask), int(found.start[found.area.argmax()]))


def four_corners(outline: np.ndarray, share: float = 0.02) -> np.ndarray:
    """The outline's corners, if they are four, as top left, top right, bottom right, bottom left; else none. Simplified to a share of its perimeter."""
    corners = simplified(outline, share * perimeter(outline)) if len(outline) else outline
    return ordered_corners(corners) if len(corners) == 4 else np.zeros((0, 2), np.int64)
