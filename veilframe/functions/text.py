"""Text similarity and repair as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts of up to so many characters are compared bit by bit in one 64-bit number.
BITS = 62


def match_masks(a: str) -> str:
    """SQL for a map from each character of a text of at most BITS characters to the places (bits) where it stands."""
    places = f"aggregate(sequence(1, length({a})), 0L, (v, i) -> v | case when substring({a}, i, 1) = c then shiftleft(1L, i - 1) else 0L end)"
    chars = f"array_distinct(transform(sequence(1, length({a})), i -> substring({a}, i, 1)))"
    return f"case when length({a}) between 1 and {BITS} then map_from_entries(transform({chars}, c -> struct(c, {places}))) end"


def indel_ratio(a: str, b: str, masks: str | None = None) -> Column:
    """Similarity 0-100 of two columns: 200 * longest common subsequence / (both lengths), rounded half to even.

    Two empty texts: 100; one empty: 0. Null if one is null. masks: a column that holds match_masks(a), where one text
    meets many. A text a of at most BITS characters is compared with a few whole-number steps for each character of b, longer ones
    row by row.
    """
    step = f"transform(array(v & coalesce(try_element_at(k, substring({b}, j, 1)), 0L)), u -> ((v + u) | (v - u)) & (shiftleft(1L, length({a})) - 1))[0]"
    fold = f"aggregate(sequence(1, length({b})), shiftleft(1L, length({a})) - 1, (v, j) -> {step})"
    short = f"length({a}) - bit_count(transform(array({masks or match_masks(a)}), k -> {fold})[0])"
    row = f"aggregate(sequence(1, length({b})), array(0), (r, j) -> array_append(r, case when substring({a}, i, 1) = substring({b}, j, 1) then element_at(old, j) + 1 else greatest(element_at(old, j + 1), element_at(r, j)) end))"
    long = f"element_at(aggregate(sequence(1, length({a})), array_repeat(0, length({b}) + 1), (old, i) -> {row}), -1)"
    lcs = f"case when length({a}) <= {BITS} then {short} else {long} end"
    return F.expr(
        f"case when {a} is null or {b} is null then null when length({a}) = 0 and length({b}) = 0 then 100 when length({a}) = 0 or length({b}) = 0 then 0 "
        f"else cast(bround(100 * (2.0D * {lcs} / (length({a}) + length({b})))) as int) end"
    )


def ratio_bound(a: str, b: str) -> Column:
    """The most that indel_ratio can be for texts of these lengths: cheap, so that most pairs need no comparison."""
    return F.expr(f"case when length({a}) + length({b}) = 0 then 100.0D else 200.0D * least(length({a}), length({b})) / (length({a}) + length({b})) end")


#: Characters that text recognition takes for digits and the colon of a clock, and what they stand for (fixed values).
LOOKALIKES = ("lI[]i|{}O.", "111111110:")


def repair_digits(text: str | Column) -> Column:
    return F.translate(text, *LOOKALIKES)


def recording_id(url: str | Column) -> Column:
    """The file name up to its first underscore."""
    return F.substring_index(F.element_at(F.split(url, "/"), -1), "_", 1)


def difference_hash(pixels: str, size: int = 8) -> Column:
    """Hash of a row-major array of size * size grey values: bit k is set if a pixel is lighter than its left neighbour.

    A 64-bit number: sizes up to 8; pixels.frame_hash() has no such bound.
    """
    if size > 8:
        raise ValueError("the bits of more than 8 * 8 pixels don't fit into a number")
    n = size
    return F.expr(
        f"cast(aggregate(filter(sequence(1, {n * n}), i -> i % {n} <> 0 and element_at({pixels}, i + 1) > element_at({pixels}, i)), 0L, "
        f"(a, i) -> a + shiftleft(1L, cast(((i - 1) div {n}) * {n - 1} + (i - 1) % {n} as int))) as string)"
    )


def wall_clock(seconds: str | Column) -> Column:
    """h:mm:ss of a duration in seconds; whole days are left out, as clocks show it."""
    s = F.pmod(F.col(seconds) if isinstance(seconds, str) else seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def pretty_age(seconds: str | Column) -> Column:
    """An age in seconds in words: 'just now', '5 minutes ago', 'yesterday', '3 weeks ago'. Negative ages: empty."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    d, r = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    some = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    today = F.when(r < 10, "just now").when(r < 60, some(r, "seconds")).when(r < 120, "a minute ago").when(r < 3600, some(r / 60, "minutes")).when(r < 7200, "an hour ago").otherwise(some(r / 3600, "hours"))
    past = F.when(d < 7, some(d, "days")).when(d < 31, some(d / 7, "weeks")).when(d < 365, some(d / 30, "months")).otherwise(some(d / 365, "years"))
    return F.when(d < 0, "").when(d == 0, today).when(d == 1, "yesterday").otherwise(past)


def from_base64url(coded: str | Column) -> Column:
    """Bytes of URL-safe base64, with or without its padding."""
    c = F.rtrim(F.translate(F.col(coded) if isinstance(coded, str) else coded, "-_", "+/"), F.lit("="))
    return F.unbase64(F.concat(c, F.repeat(F.lit("="), F.pmod(4 - F.length(c) % 4, F.lit(4)))))


def from_data_uri(uri: str | Column) -> Column:
    """Bytes of a data URI: what follows its last comma."""
    return F.unbase64(F.substring_index(uri, ",", -1))


def distance(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.expr(f"sqrt(double(power({x2} - {x1}, 2)) + double(power({y2} - {y1}, 2)))")
