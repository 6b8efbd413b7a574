"""Colours and areas of images that are given as pixels: one row each (image, b, g, r), or arrays of grey values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.grouped import in_groups


def colour_bins(pixels: DataFrame, bins: int, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """(image, kb, kg, kr, n): how many pixels lie in each cell of a cube of bins by blue, green and red (0-255)."""
    width = 256 // bins
    ok = pixels.where("b between 0 and 255 and g between 0 and 255 and r between 0 and 255")
    return ok.groupBy(*keys, *[F.floor(F.col(c) / width).cast("int").alias(f"k{c}") for c in "bgr"]).agg(F.count("*").alias("n"))


def dominant_colour(pixels: DataFrame) -> DataFrame:
    """(image, b, g, r, n): the middle of the fullest of 32 * 32 * 32 bins; of equal ones the first by blue, green, red."""
    first = F.struct(F.col("n").alias("n"), (-F.col("kb")).alias("b"), (-F.col("kg")).alias("g"), (-F.col("kr")).alias("r"))
    best = colour_bins(pixels, 32).groupBy("image").agg(F.max(first).alias("m"))
    return best.select("image", *[(F.lit(4) - 8 * F.col(f"m.{c}")).alias(c) for c in "bgr"], F.col("m.n").alias("n"))


def colours(pixels: DataFrame, bins: int = 16, least: int = 8) -> DataFrame:
    """(image, b, g, r, tolerance, n) of the bins with enough pixels: their lower corner, and how far colours may be off.

    Ordered use: by n downwards, then by colour.
    """
    step = 256 // bins
    tolerance = int((3 * (256 / bins) ** 2) ** 0.5)
    big = colour_bins(pixels, bins).where(F.col("n") >= least)
    return big.select("image", *[(F.col(f"k{c}") * step).alias(c) for c in "bgr"], F.lit(tolerance).alias("tolerance"), "n")


def colour_groups(pixels: DataFrame, most: int = 20, share: float = 0.01, closeness: int = 100) -> DataFrame:
    """(image, grp, b, g, r, n): an image's fullest bins (at most `most` of 32 * 32 * 32, each over a share of its pixels), grouped.

    Taken from the fullest on (ties by blue, green, red), a bin joins the first group whose mean is within the squared
    distance, else begins one. Colours are the middles of the groups' means.
    """
    cells = colour_bins(pixels, 32)
    total = cells.groupBy("image").agg(F.sum("n").alias("total"))
    big = cells.join(total, "image").where(F.col("n") > F.floor(F.col("total") * share))

    def groups(rows):
        out: list = []
        for i, r in enumerate(rows):
            if i == most:
                break
            at = (r["kb"], r["kg"], r["kr"])
            for g in out:
                mean = [sum(p[k] for p in g[0]) / len(g[0]) for k in range(3)]
                if sum((a - b) ** 2 for a, b in zip(at, mean, strict=True)) <= closeness:
                    g[0].append(at)
                    g[1] += r["n"]
                    break
            else:
                out.append([[at], r["n"]])
        for i, (places, n) in enumerate(out):
            yield (i, *[sum(p[k] for p in places) / len(places) * 8 + 4 for k in range(3)], n)

    return in_groups(big.select("image", (-F.col("n")).alias("fewer"), "kb", "kg", "kr", "n"), ["image"], ["fewer", "kb", "kg", "kr"], groups, "grp int, b double, g double, r double, n long")


def arrow_area(grey: str, width: int, height: int, x: int, y: int, tolerance: int = 5) -> Column:
    """Struct (x1, y1, x2, y2): how far a row-major array of grey values (0-255) keeps its colour to the four sides of a point.

    Differences are those of bytes: they wrap around, so that only pixels darker than the point by the tolerance, or
    lighter by less than 256 less it, end the area. The last pixel that differs on the left and above, the first on the right and below; the frame's
    edge if none does (to the right and below: as far again as the frame is wide and high).
    """
    at = lambda px, py: f"cast(element_at({grey}, cast(({py}) * {width} + ({px}) + 1 as int)) as int)"
    other = lambda px, py: f"pmod({at(x, y)} - {at(px, py)}, 256) > {tolerance}"
    span = lambda a, b: f"filter(sequence(0, {max(width, height)}), i -> i >= {a} and i < {b})"
    low = lambda hits: f"coalesce(array_max({hits}), 0)"
    high = lambda hits, at, end: f"coalesce(array_min({hits}), {at} + {end})"
    left, up = f"filter({span(0, x)}, i -> {other('i', y)})", f"filter({span(0, y)}, i -> {other(x, 'i')})"
    right, down = f"filter({span(x, width)}, i -> {other('i', y)})", f"filter({span(y, height)}, i -> {other(x, 'i')})"
    return F.expr(f"named_struct('x1', {low(left)}, 'y1', {low(up)}, 'x2', {high(right, x, width)}, 'y2', {high(down, y, height)})")


def flood_areas(images: DataFrame, x: int, y: int, tolerance: int = 5) -> DataFrame:
    """(image, x1, y1, x2, y2): the box of the pixels that are joined to a point by steps (up, down, left, right) between
    grey values that differ by at most the tolerance. images: image, grey (row-major array), width, height.
    Points outside of the image give (0, 0, 0, 0)."""

    def boxes(rows):
        for r in rows:
            g, w, h = r["grey"], r["width"], r["height"]
            if not (0 <= x < w and 0 <= y < h):
                yield 0, 0, 0, 0
                continue
            seen, stack = {(x, y)}, [(x, y)]
            while stack:
                a, b = stack.pop()
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < w and 0 <= d < h and (c, d) not in seen and abs(g[d * w + c] - g[b * w + a]) <= tolerance:
                        seen.add((c, d))
                        stack.append((c, d))
            yield min(p[0] for p in seen), min(p[1] for p in seen), max(p[0] for p in seen) + 1, max(p[1] for p in seen) + 1

    return in_groups(images.where("grey is not null").select("image", "grey", "width", "height"), ["image"], [], boxes, "x1 int, y1 int, x2 int, y2 int")


def frame_hash(pixels: str, discriminator: str = "gray8") -> Column:
    """Hash of a row-major array of n rows of n grey values, n from 'gray<n>': hexadecimal of its n * (n - 1) bits, one for
    each pixel that is lighter than its left neighbour, the first pixel's bit first. Other discriminators: '1', so that all frames are alike."""
    n = discriminator.removeprefix("gray")
    if not discriminator.startswith("gray") or not (n or "8").isdigit():
        return F.lit("1")
    n = int(n or 8)
    bits = f"transform(filter(sequence(1, {n * n}), i -> i % {n} <> 0), i -> case when element_at({pixels}, i + 1) > element_at({pixels}, i) then '1' else '0' end)"
    word = f"rpad(array_join({bits}, ''), {-(-n * (n - 1) // 4) * 4}, '0')"
    return F.expr(f"array_join(transform(sequence(0, {-(-n * (n - 1) // 4) - 1}), k -> lower(conv(substring({word}, k * 4 + 1, 4), 2, 16))), '')")


def frame_difference(frames: DataFrame) -> DataFrame:
    """Grey frames (movie_url, place, grey) with what is brighter in the frame before: max(0, before - now), pixel by pixel; null for the first."""
    from pyspark.sql.window import Window

    before = F.lag("grey").over(Window.partitionBy("movie_url").orderBy("place"))
    return frames.withColumn("before", before).withColumn("difference", F.expr("zip_with(before, grey, (b, g) -> greatest(b - g, 0))")).drop("before")
