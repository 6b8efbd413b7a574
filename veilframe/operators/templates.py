"""Templates looked for in whole frames by normalised correlation, over a ladder of scales.

The products come from one FFT a template and scale, the windows' means and spreads from integral images: a frame costs the
same whatever the template's size, and a few arrays of the frame's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.grouped import in_groups
from veilframe.operators.regions import match_threshold, scale_ladder

#: Matches at one scale after which a movie is looked at in that scale alone.
SETTLED = 5


def _fast(n: int) -> int:
    """The least number from n on that has no prime factor above 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def window_sums(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of all windows of h rows and w columns, from one integral image."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(a, 0, dtype=np.int64), 1, out=s[1:, 1:])
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Correlation coefficient of a template (grey, 0-255) with every window of an image. Flat windows have 0, all windows have 0
    for a flat template. Images smaller than the template have no windows."""
    h, w = template.shape
    if image.shape[0] < h or image.shape[1] < w or not template.size:
        return np.zeros((0, 0))
    n = template.size
    t = template.astype(np.int64)
    spread_t = n * int((t * t).sum()) - int(t.sum()) ** 2
    a = image.astype(np.int64)
    total = window_sums(a, h, w)
    spread = n * window_sums(a * a, h, w) - total * total  # n times the sum of squares about the mean, exact
    if not spread_t:
        return np.zeros(spread.shape)
    shape = (_fast(image.shape[0]), _fast(image.shape[1]))
    f = np.fft.rfft2(image.astype(np.float64) - 128, shape)
    f *= np.conj(np.fft.rfft2(template - template.mean(), shape))
    product = np.fft.irfft2(f, shape)[: spread.shape[0], : spread.shape[1]]
    norm = np.sqrt(spread.astype(np.float64) * spread_t) / n
    return np.divide(product, norm, out=np.zeros(spread.shape), where=spread > 0)


def _weights(old: int, new: int) -> np.ndarray:
    """How much of each old pixel goes into each new one: the covered areas, or, for more pixels than before, the two nearest."""
    out = np.zeros((new, old))
    step = old / new
    for k in range(new):
        if step > 1:
            a, b = k * step, min(old, (k + 1) * step)
            i = np.arange(int(a), min(old, int(np.ceil(b))))
            part = np.minimum(i + 1, b) - np.maximum(i, a)
            out[k, i] = part / part.sum()
        else:
            i = int(k * step)
            f = (k + 1) - (i + 1) / step
            f = 0.0 if f <= 0 else f - int(f)
            out[k, i] += 1 - f
            out[k, min(i + 1, old - 1)] += f
    return out


def resized(a: np.ndarray, width: int) -> np.ndarray:
    """The image in another width, its height in proportion (rounded down)."""
    height = int(a.shape[0] * (width / a.shape[1]))
    if (height, width) == a.shape or not height or not width:
        return a if height and width else a[:0, :0]
    return np.clip(np.rint(_weights(a.shape[0], height) @ a.astype(np.float64) @ _weights(a.shape[1], width).T), 0, 255).astype(np.uint8)


def best_match(image: np.ndarray, template: np.ndarray, scales: list[float]) -> tuple[float, int, int, float]:
    """(correlation, x, y, scale) of the best window over all scales of the image; of equal ones the first scale, then the first
    window in reading order. A flat template fits everywhere (1, at the upper left). Nothing above 0: (0, -1, -1, 0)."""
    best = (0.0, -1, -1, 0.0)
    for scale in scales:
        small = resized(image, int(image.shape[1] * scale))
        r = correlation(small, template)
        if not r.size:
            continue
        if template.min() == template.max():
            r = np.ones(r.shape)
        at = int(np.argmax(np.round(r, 9)))
        if round(float(r.flat[at]), 9) > best[0]:
            best = (round(float(r.flat[at]), 9), at % r.shape[1], at // r.shape[1], scale)
    return best


def scan(image: np.ndarray, template: np.ndarray, scales: list[float], threshold: float, multiple: bool = False):
    """(x, y, scale, correlation) of the matches above the threshold, in the image's own pixels: the best one, and with multiple,
    after it is painted black (template's size, far edges inside), the next one at the same scale, until none is left."""
    image, seen = image.copy(), set()
    while True:
        score, x, y, scale = best_match(image, template, scales)
        if score <= threshold:
            return
        scale = round(scale, 4)
        x, y = int(x / scale), int(y / scale)
        if (x, y) in seen:  # black by now, and still alike: nothing changes any more
            return
        seen.add((x, y))
        yield x, y, scale, score
        if not multiple:
            return
        image[y : y + template.shape[0] + 1, x : x + template.shape[1] + 1] = 0
        scales = [scale]


def template_matches(frames: DataFrame, templates: DataFrame, *, adaptive: bool = False) -> DataFrame:
    """(movie_url, frameset, anchor_id, n, x, y, w, h, scale, score): where templates are found in frames; n counts the matches of
    a template in a frame from 0.

    frames: movie_url, frameset, place, grey, width, height (row-major, 0-255). templates: anchor_id, grey, width, height, scale (a
    name of regions.SCALES, else 1 alone), percent (as regions.match_threshold()), multiple (see scan()). Every frame is scanned for every
    template; frames are scanned one by one, in parallel.

    adaptive: a movie's frames are taken in order of place, and once a template was found SETTLED times at one scale, that is the only scale
    tried in the rest of the movie. Faster, and it may miss what changes its scale.

    Null images and images whose number of pixels isn't width * height are skipped; of frames with equal keys each is scanned
    (all with the same result if they are alike), of templates with one anchor_id the smallest row counts. Empty tables give no rows.
    """
    t = templates.where("anchor_id is not null and grey is not null").select("anchor_id", F.struct("grey", "width", "height", "scale", match_threshold("percent", strict=False).alias("least"), F.coalesce("multiple", F.lit(False)).alias("multiple")).alias("t"))
    t = t.groupBy("anchor_id").agg(F.min("t").alias("t"))
    ladder = scale_ladder(t.select("anchor_id", F.col("t.scale").alias("scale"))).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rung", "factor"))).alias("ladder"))
    t = t.join(ladder, "anchor_id")
    ids = [r.anchor_id for r in t.select("anchor_id").distinct().collect()]
    f = frames.where("grey is not null").select("movie_url", "frameset", "place", "grey", "width", "height")
    each = f.withColumn("anchor_id", F.explode(F.array(*[F.lit(i) for i in ids]) if ids else F.expr("cast(array() as array<string>)"))).join(t, "anchor_id")
    keys = ["movie_url", "anchor_id"] if adaptive else ["movie_url", "frameset", "place", "anchor_id"]

    def find(rows):
        counts: dict = {}
        for r in rows:
            spec = r["t"]
            if len(r["grey"]) != r["width"] * r["height"] or len(spec["grey"]) != spec["width"] * spec["height"] or not r["grey"] or not spec["grey"]:
                continue
            settled = next((s for s, n in counts.items() if n >= SETTLED), None) if adaptive else None
            scales = [settled] if settled else [x["factor"] for x in r["ladder"]]
            image = np.array(r["grey"], np.uint8).reshape(r["height"], r["width"])
            template = np.array(spec["grey"], np.uint8).reshape(spec["height"], spec["width"])
            for n, (x, y, scale, score) in enumerate(scan(image, template, scales, spec["least"], spec["multiple"])):
                counts[scale] = counts.get(scale, 0) + 1
                yield *([r["frameset"], r["place"]] if adaptive else []), n, x, y, spec["width"], spec["height"], scale, score

    kinds = dict(frames.dtypes)
    added = (f"frameset {kinds['frameset']}, place {kinds['place']}, " if adaptive else "") + "n int, x int, y int, w int, h int, scale double, score double"
    found = in_groups(each.select("movie_url", "frameset", "place", "anchor_id", "grey", "width", "height", "t", "ladder"), keys, ["place"], find, added) if adaptive else in_groups(each, keys, [], find, added)
    return found.select("movie_url", "frameset", "place", "anchor_id", "n", "x", "y", "w", "h", "scale", "score")
