"""Rows, columns and grids of recognised text, and their match with an application's known layout.

Steps that depend on what was taken before (leaders, claims, greedy picks) run over one frameset's rows in a stated order.
"""

from __future__ import annotations

from collections.abc import Iterable
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.grouped import in_groups, many_groups
from veilframe.operators.sets import FRAME

BOX = "x is not null and y is not null and w is not null and h is not null"


def _uid(df: DataFrame) -> str:
    return dict(df.dtypes)["uid"]


def leaders_of(rows: list[dict], overlap: int = 5, gap: int = 1000, misalign: int = 15) -> dict:
    """The leaders of the row, left and right column of each text (by uid) of one frameset; see rows_and_columns()."""
    out: dict = {r["uid"]: [None, None, None] for r in rows}
    leaders: list = []
    for r in sorted(rows, key=lambda r: (r["x"], r["uid"])):
        x, y, right, low = r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]
        mine = None
        for o in reversed(leaders):
            top, end = o["y"], o["y"] + o["h"]
            meet = 0 if low <= top or y >= end else max(low - top, end - y)  # the larger of the two overhangs
            if meet >= overlap and max(0, o["x"] - right, x - o["x"] - o["w"]) <= gap:
                mine = o
                break
        if mine is None:
            leaders.append(mine := r)
        out[r["uid"]][0] = mine["uid"]
    down = sorted(rows, key=lambda r: (r["y"], r["uid"]))
    for k in (1, 2):
        edges: list = []
        for r in down:
            at = r["x"] if k == 1 else r["x"] + r["w"]
            mine = next((uid for edge, uid in reversed(edges) if abs(at - edge) < misalign), None)
            if mine is None:
                edges.append((at, mine := r["uid"]))
            out[r["uid"]][k] = mine
    return out


def rows_and_columns(matches: DataFrame, overlap: int = 5, gap: int = 1000, misalign: int = 15) -> DataFrame:
    """(frame, uid, row, left_col, right_col): the leader (uid) of the row and columns that each text belongs to.

    A text joins the last group whose leader is near enough, else it leads a new one. Rows are taken from left to
    right: leaders overlap by `overlap` pixels of height at least and are no further away than `gap`. Columns are taken
    from above: left (or right) edges differ by less than `misalign`. Ties go by uid. Null rectangles are left out.
    """

    groups = lambda rows: [(u, *v) for u, v in leaders_of(list(rows), overlap, gap, misalign).items()]
    kind = _uid(matches)
    return in_groups(matches.where(BOX).select(*FRAME, "uid", "x", "y", "w", "h"), list(FRAME), ["uid"], groups, f"uid {kind}, row {kind}, left_col {kind}, right_col {kind}")


def best_assignment(scores: list[list[float]]) -> tuple[list[int], float]:
    """For each column of a score matrix the row it is matched with (-1: none), rows strictly rising, largest total.

    O(rows * columns). Scores of 0 and less are no matches. Of equal totals the one that leaves out later columns first
    and takes smaller rows wins.
    """
    n_rows, n_cols = len(scores), len(scores[0]) if scores else 0
    best = [[0.0] * (n_rows + 1) for _ in range(n_cols + 1)]
    for c in range(1, n_cols + 1):
        for r in range(1, n_rows + 1):
            s = scores[r - 1][c - 1]
            best[c][r] = max(best[c - 1][r], best[c][r - 1], best[c - 1][r - 1] + s if s > 0 else 0.0)
    path, r = [-1] * n_cols, n_rows
    for c in range(n_cols, 0, -1):
        while r and best[c][r] == best[c][r - 1]:
            r -= 1
        if r and best[c][r] != best[c - 1][r]:
            path[c - 1] = r - 1
            r -= 1
    return path, best[n_cols][n_rows]


def best_rows(cells: list[tuple]) -> list[tuple]:
    """best_assignment() of one group's (ocr_row, app_row, score): (app_row, ocr_row, score, total) of the matched rows."""
    ocr, app = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    place, side = {o: i for i, o in enumerate(ocr)}, {a: i for i, a in enumerate(app)}
    table = [[0.0] * len(app) for _ in ocr]
    for o, a, s in cells:
        table[place[o]][side[a]] = float(s)
    path, total = best_assignment(table)
    return [(app[c], ocr[r], table[r][c], total) for c, r in enumerate(path) if r >= 0]


def assigned_rows(scores: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """best_assignment() for each frameset (or other keys) of (keys, ocr_row, app_row, score), rows and columns by number; missing
    scores are 0. Returns keys, app_row, ocr_row, score and the group's total, for matched rows only."""

    best = lambda rows: best_rows([(r["ocr_row"], r["app_row"], r["score"]) for r in rows])
    rows = scores.where("ocr_row is not null and app_row is not null and score is not null").select(*keys, "ocr_row", "app_row", "score")
    return in_groups(rows, list(keys), ["ocr_row", "app_row"], best, "app_row int, ocr_row int, score double, total double")


def quick_rows(cells: Iterable[tuple], threshold: int) -> list[tuple]:
    """(ocr_row, app_row, score) of one group's (ocr_row, app_row, app_pos, ocr_pos, ratio); see quick_scores()."""
    by: dict = {}
    for o, a, app_pos, ocr_pos, ratio in cells:
        by.setdefault((o, a), {}).setdefault(app_pos, []).append((ocr_pos, ratio))
    out = []
    for (o, a), own in sorted(by.items()):
        total, least = 0, None
        for pos in sorted(own):
            for at, ratio in sorted(own[pos]):
                if (least is None or at > least) and ratio >= threshold:
                    total, least = total + ratio, at
                    break
        out.append((o, a, total))
    return out


def quick_scores(pairs: DataFrame, threshold: int = 70, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """(keys, ocr_row, app_row, score): how well a row of text fits a row of the layout.

    pairs: keys (a frameset's), ocr_row, app_row, ocr_pos, app_pos, ratio. The layout's texts are taken in order, each matched with the
    first text of the row, after those already taken, that is similar enough; the ratios are added up.
    """

    names = itemgetter("ocr_row", "app_row", "app_pos", "ocr_pos", "ratio")
    score = lambda rows: quick_rows(map(names, rows), threshold)
    return in_groups(pairs.select(*keys, "ocr_row", "app_row", "ocr_pos", "app_pos", "ratio"), list(keys), ["ocr_row"], score, "ocr_row int, app_row int, score int")


def vertical_scale(tops: DataFrame, first_y: int) -> DataFrame:
    """(frame, scale, origin) from the tops of matched rows: frame, ord, app_top, ocr_top. The scale is the mean of the later rows'
    distances from the first one, found against drawn; the origin is where the layout's first row (first_y) lies. Fewer
    than two rows: scale 1, origin 0. Rows drawn at the first one's height are left out of the mean."""
    first = Window.partitionBy(*FRAME).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = tops.withColumn("a0", F.first("app_top").over(first)).withColumn("o0", F.first("ocr_top").over(first)).withColumn("n", F.row_number().over(Window.partitionBy(*FRAME).orderBy("ord")))
    scale = F.avg(F.when((F.col("n") > 1) & (F.col("app_top") != F.col("a0")), (F.col("ocr_top") - F.col("o0")) / (F.col("app_top") - F.col("a0"))))
    by = t.groupBy(*FRAME).agg(scale.alias("s"), F.min("a0").alias("a0"), F.min("o0").alias("o0"), F.max("n").alias("n"))
    return by.select(*FRAME, F.coalesce("s", F.lit(1.0)).alias("scale"), F.when(F.col("s").isNull(), F.lit(0.0)).otherwise(F.col("o0") - (F.col("a0") - first_y) * F.col("s")).alias("origin"))


def claimed_neighbours(wanted: DataFrame, texts: DataFrame, reach: float = 200.0) -> DataFrame:
    """(frame, item, uid, distance): expected places take the nearest text that is still free, one after the other.

    wanted: frame, ord, item, x, y, side ('left': a text's first corner counts, 'right': its right upper corner). Places
    whose nearest free text is out of reach take none. Ties go by uid.
    """
    w = wanted.select(*FRAME, "ord", "item", F.col("x").alias("at_x"), F.col("y").alias("at_y"), "side", F.monotonically_increasing_id().alias("place"))
    t = texts.where("x is not null and y is not null").select(*FRAME, "uid", "x", "y", F.coalesce("w", F.lit(0)).alias("w"))
    square = F.expr("cast(pow(x + if(side = 'right', w, 0) - at_x, 2) + pow(y - at_y, 2) as double)")
    # only what is within reach can be claimed, so that nothing else goes to Python
    near = w.join(t, (w.movie_url.eqNullSafe(t.movie_url)) & (w.frameset.eqNullSafe(t.frameset))).select(w.movie_url, w.frameset, "ord", "item", "place", "uid", square.alias("square")).where(F.sqrt("square") <= reach)

    def claims(rows):
        taken: set = set()
        done = None
        for r in rows:
            if r["place"] != done and r["uid"] not in taken:
                taken.add(r["uid"])
                done = r["place"]
                yield r["item"], r["uid"], r["square"] ** 0.5

    return in_groups(near, list(FRAME), ["ord", "place", "square", "uid"], claims, f"item {dict(wanted.dtypes)['item']}, uid {_uid(texts)}, distance double")


def masked_fields(items: DataFrame, ratio_to_empty: str = "empty_ratio", threshold: int = 70, *, debug: bool = False) -> DataFrame:
    """The items of a layout that are to be masked (all of them with debug); text that is about the empty value becomes empty."""
    keep = items if debug else items.where(F.coalesce("mask_this_field", F.lit(False)))
    return keep.withColumn("text", F.when(F.col(ratio_to_empty) >= threshold, F.lit("")).otherwise(F.col("text")))


#: What made-up values of a kind look like: '^' stands for a capital, '~' for a small letter, '#' for a digit, '*' for a capital or digit.
FORMS = {
    "person.first_name": "^~~~~", "person.last_name": "^~~~~~~", "person.name": "^~~~~ ^~~~~~~", "phone_number.phone_number": "###-555-####", "ssn.ssn": "###-##-####", "internet.email": "~~~~~~@example.com",
    "internet.url": "https://~~~~~~.example", "address.address": "### ^~~~~~ Street, ^~~~~~ #####", "address.city": "^~~~~~~", "address.state_short": "^^", "address.state_long": "^~~~~~~~", "address.country": "^~~~~~~",
    "address.postcode": "#####", "address.street_address": "### ^~~~~~ Street", "credit_card.credit_card_expire": "##/##", "credit_card.credit_card_number": "################", "credit_card.security_code": "###",
    "random-5": "*" * 5, "random-10": "*" * 10, "random-20": "*" * 20,
}


def synthetic(kind: str, seed: str):
    """A made-up value of a kind (column), the same for equal seeds (column): letters and digits drawn by digest.

    Kinds that are not known get ten capitals and digits.
    """
    form = F.lit("**********")
    for k, v in FORMS.items():
        form = F.when(F.col(kind) == k, F.lit(v)).otherwise(form)
    draw = f"pmod(xxhash64({seed}, {kind}, i), {{}})"
    pick = lambda letters: f"substring('{letters}', cast({draw.format(len(letters))} as int) + 1, 1)"
    low, high, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    one = f"case substring(form, i, 1) when '^' then {pick(high)} when '~' then {pick(low)} when '#' then {pick(digits)} when '*' then {pick(high + digits)} else substring(form, i, 1) end"
    return F.expr(f"array_join(transform(sequence(1, length(form)), i -> {one}), '')"), form


def with_synthetic(items: DataFrame, kind: str = "synthetic_datatype", seed: str = "app_id") -> DataFrame:
    """Items with synthetic_text, one made-up value for each seed; null kinds get random capitals and digits."""
    value, form = synthetic(kind, seed)
    return items.withColumn(kind, F.coalesce(kind, F.lit(""))).withColumn("form", form).withColumn("synthetic_text", value).drop("form")


def compiled_layout(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Texts (frame, uid, text, left_col, right_col) of one frame as a layout: type label if all their words are in the
    dictionary (word, lower case), else user_data; side: the larger of their columns, the left one of equal ones."""
    words = lines.select(*FRAME, "uid", F.explode(F.expr("filter(split(lower(text), '[^a-z0-9]+'), w -> w <> '')")).alias("word"))
    unknown = words.join(dictionary.select("word").distinct(), "word", "left_anti").select(*FRAME, "uid").distinct().withColumn("user", F.lit(True))
    n = lambda c: F.count("*").over(Window.partitionBy(*FRAME, c))
    rows = lines.join(unknown, [*FRAME, "uid"], "left").withColumn("n_left", n("left_col")).withColumn("n_right", n("right_col"))
    return rows.select(*FRAME, "uid", "text", F.when(F.col("user"), "user_data").otherwise("label").alias("type"), F.when(F.col("n_right") > F.col("n_left"), "right").otherwise("left").alias("side"))


def bunches(y: np.ndarray, group: np.ndarray, threshold: int) -> np.ndarray:
    """The number of the row that each text of sorted groups is in, as bunched() tells; y rises within a group."""
    y = y.astype(np.int64) if y.dtype.kind == "i" else y
    bunch, rest, k = np.zeros(len(y), np.int32), np.arange(len(y)), 0
    while len(rest):  # in each round every group's next row; what lies below it is left
        bunch[rest] = k
        head = np.ones(len(rest), bool)
        head[1:] = np.diff(group[rest]) > 0
        rest = rest[y[rest] - y[rest[head]][np.cumsum(head) - 1] > threshold]
        k += 1
    return bunch


def bunched(matches: DataFrame, threshold: int, *carried: str) -> DataFrame:
    """(frame, uid, bunch, carried): texts in rows by y; a new row begins where y is more than the threshold below the row's first text.
    carried: other columns that stay with the texts."""

    def rows_of(t, starts):
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        return np.arange(t.num_rows), [t.column("uid"), bunches(t.column("y").to_numpy(), group, threshold), *(t.column(c) for c in carried)]

    texts = matches.where("y is not null").select(*dict.fromkeys([*FRAME, "uid", "y", *carried]))
    ddl = "".join(f", {c} {dict(texts.dtypes)[c]}" for c in carried)
    return many_groups(texts, list(FRAME), ["y", "uid"], rows_of, f"uid {_uid(matches)}, bunch int{ddl}")


def gaps(values: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, gap): the distinct values with their distance to the one before."""
    d = values.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    return d.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))).where("gap is not null")


def row_spacing(positions: DataFrame, keys: list[str], at: str, slack: int = 10) -> DataFrame:
    """(keys, first, last, step): the most frequent distance of neighbouring positions, counted from 0 and taken in order.

    A distance counts for one that is `slack` less, else more, if that has come before. Of equally frequent ones the first
    counts; first is where it began, last is first + (count + 1) * step.
    """

    def dominant(rows):
        steps: dict = {}
        before = 0
        for r in rows:
            d = r[at] - before
            if d:
                d = d - slack if d - slack in steps else d + slack if d + slack in steps else d
                own = steps.setdefault(d, [r[at] - d, 0])
                own[1] += 1
            before = r[at]
        if steps:
            step = max(steps, key=lambda d: steps[d][1])
            first, n = steps[step]
            yield first, first + (n + 1) * step, step

    return in_groups(positions.where(F.col(at).isNotNull()).select(*keys, at).distinct(), keys, [at], dominant, "first int, last int, step int")


def histogram(matches: DataFrame, width: int, at_least: int) -> DataFrame:
    """(frame, axis, bin, n): bins of left and right edges (axis x) and of tops (axis y) with enough of them; the last bin of an
    axis holds its upper end too."""
    edges = matches.select(*FRAME, F.expr("inline(array(struct('x' axis, x at), struct('x' axis, x + w at), struct('y' axis, y at)))")).where("at is not null")
    top = edges.groupBy(*FRAME, "axis").agg(F.max("at").alias("top"))
    last = F.greatest(F.ceil(F.col("top") / width) - 1, F.lit(0))
    binned = edges.join(top, [*FRAME, "axis"]).withColumn("bin", F.least(F.floor(F.col("at") / width), last))
    return binned.groupBy(*FRAME, "axis", "bin").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def grid_areas(areas: DataFrame, columns: DataFrame, spacing: DataFrame, *, merge: bool = False, tie: bool = False) -> DataFrame:
    """Areas grown southwards over a grid: from the first to the last column (frame, at), over the rows of the dominant spacing
    (frame, first, last). tie: the grid begins where the area ends; merge: it begins with the area itself."""
    c = columns.groupBy(*FRAME).agg(F.min("at").alias("x1"), F.max("at").alias("x2"))
    rows = areas.join(c, list(FRAME)).join(spacing, list(FRAME)).where("last <> first")
    y = F.when(F.lit(merge), F.col("y")).when(F.lit(tie) | (F.col("first") < F.col("y") + F.col("h")), F.expr("y + h")).otherwise(F.col("first"))
    return rows.select(*FRAME, "uid", F.col("x1").alias("x0"), y.alias("y0"), F.expr("x2 - x1").alias("w0"), F.expr("last - first").alias("h0")).toDF(*FRAME, "uid", "x", "y", "w", "h")


def suppressed(boxes: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Boxes (frame, uid, x, y, w, h, score) that stay: the best first, each takes away those that it covers by more than `overlap`.

    Overlaps are in pixels with both edges, as shares of the other box. Ties go by the larger uid.
    """

    def pick(rows):
        kept: list = []
        for r in rows:
            area = (r["w"] + 1) * (r["h"] + 1)
            for k in kept:
                across = max(0, min(r["x"] + r["w"], k["x"] + k["w"]) - max(r["x"], k["x"]) + 1)
                down = max(0, min(r["y"] + r["h"], k["y"] + k["h"]) - max(r["y"], k["y"]) + 1)
                if across * down / area > overlap:
                    break
            else:
                kept.append(r)
                yield (r["uid"],)

    rows = boxes.where(BOX + " and score is not null").select(*FRAME, (-F.col("score")).alias("worse"), (-F.col("uid")).alias("older"), "uid", "x", "y", "w", "h")
    kept = in_groups(rows, list(FRAME), ["worse", "older"], pick, f"uid {_uid(boxes)}")
    return boxes.join(kept, [*FRAME, "uid"], "left_semi")
