"""A window detector: histograms of gradient directions, a linear classifier over them, windows over scales, mistakes fed back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.grouped import each_image, in_groups
from veilframe.operators.templates import resized
from veilframe.sources.shared import stored


#: Windows whose vectors are in memory at once, in whole rows of windows.
BAND = 1024
#: Pieces that the sums of a fit are dealt out in.
PIECES = 64


@dataclass(frozen=True)
class Spec:
    """Size of the window, of a cell and of a block (in cells), number of directions, step between windows; root: of the greys first."""

    width: int = 32
    height: int = 32
    cell: int = 8
    block: int = 2
    directions: int = 9
    step: int = 4
    root: bool = True

    @property
    def cells(self) -> tuple[int, int]:
        return self.height // self.cell, self.width // self.cell

    @property
    def size(self) -> int:
        down, across = self.cells
        return (down - self.block + 1) * (across - self.block + 1) * self.block**2 * self.directions


def _histograms(a: np.ndarray, spec: Spec) -> np.ndarray:
    """Integral images of the gradients' sizes, one for each direction (0-180 degrees)."""
    v = np.sqrt(a.astype(float)) if spec.root else a.astype(float)
    gy, gx = np.zeros(v.shape), np.zeros(v.shape)
    gy[1:-1], gx[:, 1:-1] = v[2:] - v[:-2], v[:, 2:] - v[:, :-2]
    bin_ = np.minimum((np.degrees(np.arctan2(gy, gx)) % 180 / 180 * spec.directions).astype(int), spec.directions - 1)
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1, spec.directions))
    np.put_along_axis(out[1:, 1:], bin_[:, :, None], np.hypot(gy, gx)[:, :, None], 2)
    return np.cumsum(np.cumsum(out, 0, out=out), 1, out=out)


def windows(a: np.ndarray, spec: Spec):
    """For each row of windows (their y, the x of each, a matrix with a feature vector for each): cells' histograms, put together in
    overlapping blocks that each add up to 1. Gradients are those of the whole image."""
    if a.shape[0] < spec.height or a.shape[1] < spec.width:
        return
    s, c, b = _histograms(a, spec), spec.cell, spec.block
    cells = s[c:, c:] - s[:-c, c:] - s[c:, :-c] + s[:-c, :-c]  # of the cell that starts at each pixel
    x, tops = np.arange(0, a.shape[1] - spec.width + 1, spec.step), np.arange(0, a.shape[0] - spec.height + 1, spec.step)
    down, across = spec.cells
    left = x[:, None] + c * np.arange(across)
    for first in range(0, len(tops), rows := max(1, BAND // len(x))):
        top = tops[first : first + rows, None] + c * np.arange(down)
        own = cells[top[:, None, :, None], left[None, :, None, :]]  # rows of windows, windows, down, across, directions
        v = np.empty((len(top), len(x), spec.size))
        for k, (i, j) in enumerate((i, j) for i in range(down - b + 1) for j in range(across - b + 1)):
            block = own[:, :, i : i + b, j : j + b].reshape(len(top), len(x), -1)
            n = block.shape[2]
            np.divide(block, block.sum(2, keepdims=True) + 1e-5, out=v[:, :, k * n : (k + 1) * n])
        yield from ((int(y), x, row) for y, row in zip(tops[first : first + rows], v, strict=True))


def described(a: np.ndarray, spec: Spec) -> np.ndarray:
    """The feature vector of an image, brought to the window's size."""
    small = resized(a, spec.width)
    if small.shape != (spec.height, spec.width):  # another shape: both sides on their own
        small = resized(resized(a, spec.width).T.copy(), spec.height).T if small.size else np.zeros((spec.height, spec.width), np.uint8)
        full = np.zeros((spec.height, spec.width), np.uint8)
        full[: small.shape[0], : small.shape[1]] = small[: spec.height, : spec.width]
        small = full
    return next(windows(small, spec))[2][0]


@dataclass
class Model:
    spec: Spec
    weights: np.ndarray
    bias: float

    def probability(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v @ self.weights + self.bias, -50, 50)))


def _sums(v: np.ndarray, label: np.ndarray, at: np.ndarray, weights: tuple[float, float], spec: Spec) -> np.ndarray:
    """Added up over vectors, one after the other: loss, its slope and its curvature at the weights and bias `at`. weights: of a true
    and of a false vector. A band of vectors is in memory at once besides what is given."""
    n = len(at)
    out = np.zeros(1 + n + n * n)
    for k in range(0, len(v), BAND):
        x, yes = np.column_stack([v[k : k + BAND] * np.sqrt(spec.size), np.ones(len(v[k : k + BAND]))]), label[k : k + BAND]
        z, weight = x @ at, np.where(yes, *weights)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        out[0] += weight @ (np.logaddexp(0, z) - yes * z)
        out[1 : n + 1] += x.T @ (weight * (p - yes))
        out[n + 1 :] += ((x * (weight * p * (1 - p))[:, None]).T @ x).reshape(-1)
    return out


def _minimum(sums: Callable[[np.ndarray], np.ndarray], at: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Where the loss with its penalty is least, by Newton's steps from `at`, each halved until the loss falls; sums: see _sums()."""
    n, ridge = len(at), np.append(np.full(len(at) - 1, penalty), 0.0)

    def seen(at):
        s = sums(at)
        return s[0] + ridge @ (at * at) / 2, s[1 : n + 1] + ridge * at, s[n + 1 :].reshape(n, n) + np.diag(np.maximum(ridge, 1e-12))

    loss, slope, curve = seen(at)
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        gain = slope @ step
        if gain < 1e-12:  # so near that the next step can't be told from none
            return at - step
        new = seen(at - step)
        while new[0] > loss - 1e-4 * gain:
            step, gain = step / 2, gain / 2
            if gain < 1e-15:
                return at
            new = seen(at - step)
        at, (loss, slope, curve) = at - step, new
    return at


def _model(at: np.ndarray, spec: Spec) -> Model:
    return Model(spec, at[:-1] * np.sqrt(spec.size), float(at[-1]))


def fitted(v: np.ndarray, label: np.ndarray, spec: Spec, penalty: float = 1e-3, steps: int = 400) -> Model:
    """Logistic regression by Newton's method; both labels weigh the same."""
    weights = 0.5 / max(1, label.sum()), 0.5 / max(1, (~label).sum())
    return _model(_minimum(lambda at: _sums(v, label, at, weights, spec), np.zeros(v.shape[1] + 1), penalty, steps), spec)


def learnt(rows: DataFrame, spec: Spec, penalty: float = 1e-3, steps: int = 400, last: Model | None = None) -> Model | None:
    """fitted() to all rows (label, v) of a table, from `last` on if given; None if a label has none.

    Each step reads the table once. A task adds up its rows, the tasks' sums are added up in pieces, and the driver gets the sums: their
    size is that of (spec.size + 1) squared numbers, whatever the number of rows.
    """
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(True) or not n.get(False):
        return None
    weights = 0.5 / n[True], 0.5 / n[False]

    def sums(at):
        def of_rows(batches):
            total, part = None, TaskContext.get().partitionId()
            for b in batches:
                if b.num_rows:
                    v, label = b.column("v").flatten().to_numpy().reshape(b.num_rows, spec.size), b.column("label").to_numpy(zero_copy_only=False)
                    own = _sums(v, label, at, weights, spec)
                    total = own if total is None else np.add(total, own, out=total)
            if total is not None:
                pieces = [x.tobytes() for x in np.array_split(total, PIECES)]
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "part": pa.array([part] * PIECES, pa.int32()), "sums": pa.array(pieces, pa.binary())})

        def of_parts(parts):
            yield (reduce(np.add, (np.frombuffer(r["sums"]) for r in parts)).tobytes(),)

        parts = rows.select("label", "v").mapInArrow(of_rows, "piece int, part int, sums binary")
        # in order of parts, so that sums are rounded alike each time
        total = in_groups(parts, ["piece"], ["part"], of_parts, "sums binary").collect()
        return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(total, key=lambda r: r["piece"])])

    start = np.zeros(spec.size + 1) if last is None else np.append(last.weights / np.sqrt(spec.size), last.bias)
    return _model(_minimum(sums, start, penalty, steps), spec)


def _with_boxes(frames: DataFrame, truths: DataFrame) -> DataFrame:
    """Frames with their true boxes, sorted. The number of parts is given, so that it does not depend on the pixels' size, as Python takes long for each."""
    keys, parts = ["movie_url", "frameset"], int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = truths.where("x is not null and y is not null and w > 0 and h > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("boxes"))
    return frames.where("grey is not null").select(*keys, "grey", "width", "height").repartition(parts, *keys).join(own, keys, "left")


def examples(frames: DataFrame, truths: DataFrame, spec: Spec, distractions: int = 20) -> DataFrame:
    """(movie_url, frameset, label, v): feature vectors of the true boxes (movie_url, frameset, x, y, w, h; label true), and of
    `distractions` windows of each frame after its boxes were painted in the grey of their upper left corner (label false). Where these
    windows lie is drawn from a generator seeded by the frame's pixels. Null images and boxes, and boxes outside, give nothing."""
    rows = _with_boxes(frames, truths)

    def describe(r):
        a = _pixels(r)
        if a is None:
            return
        blank = a.copy()
        for b in r["boxes"] or ():
            cut = (slice(max(0, b["y"]), max(0, b["y"] + b["h"])), slice(max(0, b["x"]), max(0, b["x"] + b["w"])))
            if a[cut].size:
                yield True, described(a[cut], spec)
                blank[cut] = a[cut][0, 0]
        rng = np.random.default_rng(np.frombuffer(a.tobytes()[:4096].ljust(8, b"\0"), np.uint8))
        for _ in range(distractions if a.shape[0] >= spec.height and a.shape[1] >= spec.width else 0):
            y, x = int(rng.integers(0, a.shape[0] - spec.height + 1)), int(rng.integers(0, a.shape[1] - spec.width + 1))
            yield False, described(blank[y : y + spec.height, x : x + spec.width], spec)

    return each_image(rows, ["movie_url", "frameset"], describe, "label boolean, v array<double>")


def _pixels(r: dict) -> np.ndarray | None:
    """A row's image; none if its pixels aren't width * height."""
    if r["grey"] is None or not len(r["grey"]) or len(r["grey"]) != r["width"] * r["height"]:
        return None
    return np.array(r["grey"], np.uint8).reshape(r["height"], r["width"])


def _found(a: np.ndarray, model: Model, scales: tuple[float, ...], least: float):
    """detect() for one image."""
    for scale in scales:
        for y, xs, v in windows(resized(a, int(a.shape[1] * scale)), model.spec):
            p = model.probability(v)
            for k in np.flatnonzero(p > least).tolist():
                yield int(xs[k] / scale), int(y / scale), int(model.spec.width / scale), int(model.spec.height / scale), scale, float(p[k])


def detect(frames: DataFrame, model: Model, scales: tuple[float, ...] = (1.0,), least: float = 0.9) -> DataFrame:
    """(movie_url, frameset, x, y, w, h, scale, score): the windows, over all scales of the frame, whose probability is above `least`, in the
    frame's own pixels (rounded down). Null images and those whose pixels aren't width * height have none."""

    def find(r):
        a = _pixels(r)
        return () if a is None else _found(a, model, scales, least)

    rows = frames.where("grey is not null").select("movie_url", "frameset", "grey", "width", "height")
    return each_image(rows, ["movie_url", "frameset"], find, "x int, y int, w int, h int, scale double, score double")


def false_alarms(frames: DataFrame, truths: DataFrame, model: Model, scales: tuple[float, ...], least: float, overlap: float = 0.3) -> DataFrame:
    """(movie_url, frameset, label, v): vectors of detected windows that no true box covers by more than `overlap` of their area: hard negatives."""
    rows = _with_boxes(frames.where("movie_url is not null and frameset is not null"), truths)
    spec = model.spec

    def describe(r):
        a = _pixels(r)
        for x, y, w, h in sorted(f[:4] for f in _found(a, model, scales, least)) if a is not None else ():
            cover = max((max(0, min(x + w, b["x"] + b["w"]) - max(x, b["x"])) * max(0, min(y + h, b["y"] + b["h"]) - max(y, b["y"])) for b in r["boxes"] or ()), default=0)
            if cover <= overlap * w * h:
                yield False, described(a[y : y + h, x : x + w], spec)

    return each_image(rows, ["movie_url", "frameset"], describe, "label boolean, v array<double>")


def train(frames: DataFrame, truths: DataFrame, spec: Spec, *, scales: tuple[float, ...] = (1.0,), least: float = 0.9, rounds: int = 1, distractions: int = 20) -> Model:
    """A model learnt from labelled frames; after each of `rounds` rounds what it took for a box by mistake is added as negative.

    It is fitted to all vectors of all frames, which are made, stored and added up on the cluster (see learnt()). Without a true box,
    or without frames, nothing is ever detected.
    """
    # sorted, so that the sums over a part are rounded alike each time
    kept = lambda df: stored(df.sortWithinPartitions("movie_url", "frameset", "label", F.xxhash64("v")).select("label", "v"))
    rows = kept(examples(frames, truths, spec, distractions))
    model = learnt(rows, spec)
    if model is None:
        return Model(spec, np.zeros(spec.size), -50.0)
    for _ in range(rounds):
        more = kept(false_alarms(frames, truths, model, scales, least))
        if more.isEmpty():
            break
        rows = rows.unionByName(more)
        model = learnt(rows, spec, last=model)
    return model
