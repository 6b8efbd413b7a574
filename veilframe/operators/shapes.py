"""Small image helpers on arrays: runs and components, running minima and maxima, gradients, lines, edges."""

from __future__ import annotations

import numpy as np


class Runs:
    """The runs of set pixels of a mask, row by row, and the component that each belongs to (numbered in reading order).

    corners: pixels that touch at corners alone belong together as well.
    """

    def __init__(self, mask: np.ndarray, corners: bool = True):
        other = np.ones(len(mask), bool)  # a row like the one above has its runs, each joined to the run above alone
        other[1:] = (mask[1:] != mask[:-1]).any(1)
        step = mask.shape[1] + 2
        wide = np.zeros((int(other.sum()), step), bool)
        wide[:, 1:-1] = mask[other]
        flat = wide.reshape(-1)
        row, at = np.divmod(np.flatnonzero(flat[1:] != flat[:-1]), step)  # runs begin and end in turn
        row, start, end = row[::2], at[::2], at[1::2]
        first, last = row * step + start, row * step + end
        lo = np.searchsorted(last, first + step, "left" if corners else "right")
        hi = np.searchsorted(first, last + step, "right" if corners else "left")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(n)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        label = _joined(len(n), a, b)
        number = np.cumsum(label == np.arange(len(label))) - 1
        self.n = int(number[-1]) + 1 if len(label) else 0
        runs = np.bincount(row, minlength=len(wide))
        like = np.cumsum(other) - 1
        own = runs[like]
        k = np.repeat((np.cumsum(runs) - runs)[like] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        self.row, self.start, self.end, self.label = np.repeat(np.arange(len(mask)), own), start[k], end[k], number[label][k]

    def boxes(self) -> np.ndarray:
        """x, y, width, height, pixels of each component."""
        out = np.zeros((self.n, 5), np.int64)
        out[:, 0], out[:, 1] = 1 << 60, 1 << 60
        np.minimum.at(out[:, 0], self.label, self.start)
        np.minimum.at(out[:, 1], self.label, self.row)
        np.maximum.at(out[:, 2], self.label, self.end)
        np.maximum.at(out[:, 3], self.label, self.row + 1)
        np.add.at(out[:, 4], self.label, self.end - self.start)
        out[:, 2] -= out[:, 0]
        out[:, 3] -= out[:, 1]
        return out

    def holding(self, where: np.ndarray) -> np.ndarray:
        """For each component whether any of its pixels is set in another mask."""
        sums = np.zeros((where.shape[0], where.shape[1] + 1), np.int64)
        np.cumsum(where, 1, out=sums[:, 1:])
        out = np.zeros(self.n, bool)
        np.logical_or.at(out, self.label, sums[self.row, self.end] > sums[self.row, self.start])
        return out

    def painted(self, wanted: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """The mask of the components that are wanted."""
        out = np.zeros((shape[0], shape[1] + 1), np.int64)
        on = wanted[self.label]
        np.add.at(out, (self.row[on], self.start[on]), 1)
        np.add.at(out, (self.row[on], self.end[on]), -1)
        return np.cumsum(out, 1)[:, :-1] > 0


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the smallest number of those that links a[i] - b[i] join it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Tones:
    """The areas of a grey image that are joined by steps (up, down, left, right) between values that differ by at most a tolerance,
    all at once."""

    def __init__(self, grey: np.ndarray, tolerance: int):
        g = grey.astype(np.int64)
        start = np.ones(g.shape, bool)
        start[:, 1:] = np.abs(np.diff(g, axis=1)) > tolerance
        self.run = np.cumsum(start.reshape(-1)).reshape(g.shape) - 1
        down = np.abs(np.diff(g, axis=0)) <= tolerance
        links = np.unique(np.stack([self.run[:-1][down], self.run[1:][down]], 1), axis=0)
        n = int(self.run[-1, -1]) + 1
        self.label = _joined(n, links[:, 0], links[:, 1])
        row, x1 = np.nonzero(start)
        x2 = np.append(x1[1:], 0)
        x2[np.append(row[1:] != row[:-1], True)] = g.shape[1]
        self.boxes = np.array([[g.shape[1]], [g.shape[0]], [0], [0]]).repeat(n, 1)
        for fn, out, at in ((np.minimum, 0, x1), (np.minimum, 1, row), (np.maximum, 2, x2), (np.maximum, 3, row + 1)):
            fn.at(self.boxes[out], self.label, at)

    def box(self, x: int, y: int) -> tuple[int, int, int, int] | None:
        """x1, y1, x2, y2 (the far edges outside) of the area that holds a point; None outside of the image."""
        if not (0 <= y < self.run.shape[0] and 0 <= x < self.run.shape[1]):
            return None
        return tuple(self.boxes[:, self.label[self.run[y, x]]].tolist())


#: Up to so many components are compared with each other, box by box, before the gaps between them are searched.
FEW = 64


def outer_components(grid: np.ndarray) -> list[tuple[int, int, int, int]]:
    """First and last column and row (x, y, x, y) of each outer component of a mask: cells that touch, corners included, from
    which the outside can be reached."""
    if not grid.any():
        return []
    full = np.pad(grid, 1)
    own = Runs(full)
    x, y, w, h, _ = own.boxes().T
    corners = np.stack([x - 1, y - 1, x + w - 2, y + h - 2], 1)
    if own.n <= FEW:  # what is shut in lies within the other one's box
        within = [np.greater.outer(x, x), np.greater.outer(y, y), np.less.outer(x + w, x + w), np.less.outer(y + h, y + h)]
        if not np.logical_and.reduce(within).any():
            return [tuple(c) for c in corners.tolist()]
    gaps = Runs(~full, corners=False)
    outside = np.zeros((full.shape[0] + 2, full.shape[1] + 2), bool)
    outside[1:-1, 1:-1] = gaps.painted(np.arange(gaps.n) == 0, full.shape)  # the first gap begins at the upper left
    beside = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
    return [tuple(c) for c in corners[own.holding(beside)].tolist()]


def _running(a: np.ndarray, axis: int, reach: int, fn, edge: int) -> np.ndarray:
    """fn (minimum or maximum) over 2 * reach + 1 neighbours along an axis; nothing beyond the border counts."""
    if not reach:
        return a
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    x = np.moveaxis(np.pad(a, pad, constant_values=edge), axis, 0)
    span, want = 1, 2 * reach + 1
    while span < want:
        more = min(span, want - span)
        x = fn(x[: len(x) - more], x[more:])
        span += more
    return np.moveaxis(x, 0, axis)


def eroded(a: np.ndarray, x: int, y: int) -> np.ndarray:
    """The least grey within x columns and y rows; as a kernel of three pixels applied so many times."""
    return _running(_running(a, 1, x, np.minimum, 255), 0, y, np.minimum, 255)


def dilated(a: np.ndarray, x: int, y: int) -> np.ndarray:
    """The largest grey within x columns and y rows."""
    return _running(_running(a, 1, x, np.maximum, 0), 0, y, np.maximum, 0)


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel's differences across and down (3 x 3, mirrored at the border)."""
    p = np.pad(a.astype(np.int16 if a.dtype == np.uint8 else np.int64), 1, mode="reflect" if min(a.shape) > 1 else "edge")
    across = p[:, 2:] - p[:, :-2]
    down = p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def strength(a: np.ndarray) -> np.ndarray:
    """Mean of both gradients' sizes, each at most 255."""
    gx, gy = gradients(a)
    both = np.minimum(abs(gx), 255) + np.minimum(abs(gy), 255)
    return (both + (both >> 1 & 1) >> 1).astype(np.uint8)  # halves to the even number


def frames_of(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x, y, w, h, area) of what a mask draws: its components, corners joined, and the holes in them, each with the line
    of pixels around it (area of a hole: that of the box through these). In reading order, components first."""
    out = [tuple(b) for b in Runs(mask).boxes().tolist()]
    for x, y, w, h, _ in Runs(~mask, corners=False).boxes().tolist():
        if x > 0 and y > 0 and x + w < mask.shape[1] and y + h < mask.shape[0]:
            out.append((x - 1, y - 1, w + 2, h + 2, (w + 1) * (h + 1)))
    return out


def edges(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny's edges: gradients (sum of both sizes) that are the largest across their direction, above `low` and joined to one
    above `high`."""
    gx, gy = gradients(a)
    size = abs(gx) + abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = abs(gy) < np.tan(np.pi / 8) * abs(gx), abs(gy) > np.tan(3 * np.pi / 8) * abs(gx)
    same = (gx < 0) == (gy < 0)
    top = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))))
    weak = top & (size > low)
    r = Runs(weak)
    return r.painted(r.holding(weak & (size > high)), a.shape) if r.n else weak
