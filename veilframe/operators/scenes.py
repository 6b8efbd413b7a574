"""Scene analysis: which applications a screen shows, found by growing matches over the grids of their phrases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators import layout as L
from veilframe.operators.grouped import in_groups, many_groups
from veilframe.operators.sets import FRAME
from veilframe.operators.sifter import densest_frames, grouped_texts
from veilframe.operators.texts import similar
from veilframe.sources.shared import stored


def text_grid(texts: DataFrame, row_gap: int = 10) -> DataFrame:
    """(frame, uid, text, row, col, x1, y1, x2, y2): texts in rows from above, in a row from the left; both count from 0.

    A row begins where a text is more than row_gap below the row's first one. Texts with a null in their box are left out;
    null texts keep their place. Ties go by uid.
    """
    rows = L.bunched(texts.where(L.BOX), row_gap, "text", "x", "y", "w", "h").where("uid is not null")
    col = F.row_number().over(Window.partitionBy(*FRAME, "bunch").orderBy("x", "uid")) - 1
    return rows.select(*FRAME, "uid", "text", F.col("bunch").alias("row"), col.alias("col"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("x + w").alias("x2"), F.expr("y + h").alias("y2"))


def phrase_grid(phrases: DataFrame) -> DataFrame:
    """(app, app_row, app_col, phrase): each application's rows of phrases (row_no, pos), counted anew from 0. Null phrases
    keep their row and are left out."""
    p = phrases.where("app is not null and row_no is not null and pos is not null").select("app", "row_no", "pos", F.col("text").alias("phrase"))
    row = F.dense_rank().over(Window.partitionBy("app").orderBy("row_no")) - 1
    col = F.row_number().over(Window.partitionBy("app", "row_no").orderBy("pos", "phrase")) - 1
    return p.withColumn("app_row", row).withColumn("app_col", col).where("phrase is not null").select("app", "app_row", "app_col", "phrase")


class _Hits:
    """The texts of one screen that are similar to phrases of one application, by phrase."""

    def __init__(self, rows):
        self.at: dict = {}
        for r in rows:
            self.at.setdefault((r["app_row"], r["app_col"]), []).append(r)
        for own in self.at.values():
            own.sort(key=lambda r: (r["row"], r["col"]))
        self.phrases = sorted(self.at)
        self.most = next(((r["max_width"], r["max_height"]) for own in self.at.values() for r in own), (None, None))

    def grown(self, box, r):
        """The box with a text in it, or None if it would be too large."""
        new = (min(box[0], r["x1"]), min(box[1], r["y1"]), max(box[2], r["x2"]), max(box[3], r["y2"]))
        fits = all(m is None or size <= m for m, size in zip(self.most, (new[2] - new[0], new[3] - new[1])))
        return new if fits else None

    def score(self, home, first):
        """Total and box of what grows from one text as one phrase, and the phrases with the texts taken for them."""
        total, box = first["ratio"], (first["x1"], first["y1"], first["x2"], first["y2"])
        taken = [(home, first)]
        start = (first["row"], first["col"])
        last = start
        for phrase in reversed([p for p in self.phrases if 0 < p[0] < home[0]]):
            for r in reversed(self.at[phrase]):
                here = (r["row"], r["col"])
                if 0 < here[0] < start[0] and here < last and (new := self.grown(box, r)):
                    total, box, last = total + r["ratio"], new, here
                    taken.append((phrase, r))
                    break
        last = start
        for phrase in [p for p in self.phrases if p[0] > home[0]]:
            for r in self.at[phrase]:
                free = r["row"] > start[0] and (r["row"] > last[0] or r["col"] > last[1])
                if free and (new := self.grown(box, r)):
                    total, box, last = total + r["ratio"], new, (r["row"], r["col"])
                    taken.append((phrase, r))
                    break
        return total, box, taken


def _similar_phrases(texts: DataFrame, phrases: DataFrame, threshold: int) -> DataFrame:
    """Distinct texts with each phrase of an application's grid that they are similar to, and the application's largest extent."""
    p = phrase_grid(phrases)
    size = phrases.groupBy("app").agg(F.max("max_width").alias("max_width"), F.max("max_height").alias("max_height"))
    alike = similar(texts.where(L.BOX).select("text"), p.select("phrase").distinct(), threshold)
    return alike.join(p.join(size, "app"), "phrase").select("text", "app", "ratio", "app_row", "app_col", "max_width", "max_height")


ORDER = ["app_row", "app_col", "row", "col"]
#: An extent that no box exceeds.
ENDLESS = 2**31 - 1


def grid_scores(texts: DataFrame, phrases: DataFrame, threshold: int = 80, row_gap: int = 10) -> DataFrame:
    """(frame, app, uid, row, col, score, app_row, app_col, x1, y1, x2, y2): for each text that is similar to one of an
    application's phrases, the best score of a match that grows from it.

    texts: frame, uid, text, x, y, w, h, taken as text_grid(). phrases: app, row_no, pos, text, max_width, max_height (the
    application's largest extent, null: no limit), taken as phrase_grid(). Similar: a ratio above the threshold.

    A match starts with a text as one phrase, for their ratio. Upwards, phrases of the rows above are taken from the nearest row
    and from the right; each takes the nearest similar text in the rows above, read backwards, that lies before the last one
    taken. Downwards, phrases are taken in reading order; each takes the first similar text in the rows below that
    lies in a later row or in a later column than the last one taken. Row 0, of texts and of phrases, is never looked at
    upwards. A text that would make the box of all texts so far wider or higher than the application's largest extent is
    passed over. Each taken text adds its ratio. Other texts of the starting row add nothing.

    Of several phrases for a text the one with the largest score counts, of equal ones the first of the phrases' grid. A group
    is a screen's texts that are similar to one application's phrases. Empty tables give no rows.
    """
    def best(t, starts):
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        x, y, w, h = (t.column(c).to_numpy().astype(np.int64) for c in "xywh")
        row = L.bunches(y, group, row_gap)
        uid = t.column("uid").combine_chunks()
        there = uid.is_valid().to_numpy(zero_copy_only=False)
        col = _columns(x, pc.rank(uid, tiebreaker="dense").to_numpy(), there, row, group)
        lists = t.column("hits").combine_chunks()
        text = np.repeat(np.arange(t.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.flatten())])
        hit = lambda c, none=0: flat.column(c).fill_null(none).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        app = flat.column("app").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        by = np.lexsort((col[text], row[text], hit("app_col"), hit("app_row"), app, group[text]))
        by = by[there[text[by]]]
        text, app = text[by], app[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (np.diff(group[text]) != 0) | (np.diff(app) != 0)
        first = np.flatnonzero(fresh)
        at = dict(zip(ORDER, (hit("app_row")[by], hit("app_col")[by], row[text], col[text]), strict=True))
        ratio = flat.column("ratio").to_numpy().astype(np.float64)[by]
        total, box = _grown_totals(first, np.diff(np.append(first, len(by))), np.cumsum(fresh) - 1, at, ratio, [v[text] for v in (x, y, x + w, y + h)], [hit(c, ENDLESS)[by] for c in ("max_width", "max_height")])
        same = uid.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[text]
        rank = np.lexsort((np.arange(len(by)), -total, same, np.cumsum(fresh)))
        won = np.ones(len(by), bool)
        won[1:] = (np.diff(np.cumsum(fresh)[rank]) != 0) | (np.diff(same[rank]) != 0)
        won = np.sort(rank[won])
        mine = text[won]
        return mine, [flat.column("app").take(pa.array(by[won])), uid.take(pa.array(mine)), *(at[c][won] for c in ("row", "col")), total[won], *(at[c][won] for c in ("app_row", "app_col")), *(v[won] for v in box)]

    kinds = dict(texts.dtypes) | dict(phrases.dtypes)
    hits = _similar_phrases(texts, phrases, threshold).groupBy("text").agg(F.collect_list(F.struct("app", "ratio", "app_row", "app_col", "max_width", "max_height")).alias("hits"))
    rows = texts.where(L.BOX).select(*FRAME, "uid", "text", "x", "y", "w", "h").join(hits, "text", "left").drop("text")
    return many_groups(rows, list(FRAME), ["y", "uid"], best, f"app {kinds['app']}, uid {kinds['uid']}, row int, col int, score double, app_row int, app_col int, x1 int, y1 int, x2 int, y2 int")


def _columns(x, rank, there, row, group):
    """Each text's column: its number among those of its row that have an id, from the left, then by id."""
    by = np.lexsort((rank, x, row, group))
    by = by[there[by]]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (np.diff(group[by]) != 0) | (np.diff(row[by]) != 0)
    col = np.zeros(len(x), np.int32)
    col[by] = np.arange(len(by)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return col


def _grown_totals(starts, size, group, at, ratio, box, most):
    """Total and box of what grows from each hit, as _Hits.score() has it, for the hits of many groups at once.

    A group's hits lie in the order of phrases, then of texts. Step k looks at every group's k-th hit from the end (upwards) or from the start
    (downwards) for all hits that something grows from; those of large groups stand first, so that a step takes the ones in front.
    """
    front = np.argsort(-size[group], kind="stable")
    lo, many = starts[group][front], size[group][front]
    p_row, p_col, row, col = (at[c] for c in ORDER)
    change = np.ones(len(group), bool)
    change[1:] = (np.diff(group) != 0) | (np.diff(p_row) != 0) | (np.diff(p_col) != 0)
    phrase = np.cumsum(change)
    home, s_row, s_col = p_row[front], row[front], col[front]
    total, now, widest = ratio[front], [b[front] for b in box], [m[front] for m in most]
    for up in (True, False):
        l_row, l_col, taken = s_row.copy(), s_col.copy(), np.zeros(len(front), np.int64)
        for k in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-many, -k))  # groups of more than k hits
            j = lo[:m] + (many[:m] - 1 - k if up else k)
            rj, cj, pj = row[j], col[j], p_row[j]
            if up:
                ok = (pj > 0) & (pj < home[:m]) & (rj > 0) & (rj < s_row[:m]) & ((rj < l_row[:m]) | ((rj == l_row[:m]) & (cj < l_col[:m])))
            else:
                ok = (pj > home[:m]) & (rj > s_row[:m]) & ((rj > l_row[:m]) | (cj > l_col[:m]))
            i = np.flatnonzero(ok & (phrase[j] != taken[:m]))
            j = j[i]
            new = [np.minimum(now[0][i], box[0][j]), np.minimum(now[1][i], box[1][j]), np.maximum(now[2][i], box[2][j]), np.maximum(now[3][i], box[3][j])]
            fits = (new[2] - new[0] <= widest[0][i]) & (new[3] - new[1] <= widest[1][i])
            i, j = i[fits], j[fits]
            total[i] += ratio[j]
            for own, b in zip(now, new, strict=True):
                own[i] = b[fits]
            l_row[i], l_col[i], taken[i] = row[j], col[j], phrase[j]
    back = np.empty_like(front)
    back[front] = np.arange(len(front))
    return total[back], [b[back] for b in now]


def grid_cells(texts: DataFrame, phrases: DataFrame, threshold: int = 80, row_gap: int = 10) -> DataFrame:
    """(frame, app, app_row, app_col, uid, ratio): the phrases of an application that its best match on a screen has a text for,
    with that text. The match is the one that scene_apps() takes; for the rest see grid_scores()."""

    def cells(rows):
        hits, most, best = _Hits(rows), None, []
        for r, phrase in sorted(((r, p) for p in hits.phrases for r in hits.at[p]), key=lambda x: (x[0]["row"], x[0]["col"], x[1])):
            total, _, taken = hits.score(phrase, r)
            if most is None or total > most:
                most, best = total, taken
        return [(*p, r["uid"], float(r["ratio"])) for p, r in sorted(best, key=lambda x: x[0])]

    kind = dict(texts.dtypes)["uid"]
    hits = text_grid(texts, row_gap).join(_similar_phrases(texts, phrases, threshold), "text")
    return in_groups(hits, [*FRAME, "app"], ORDER, cells, f"app_row int, app_col int, uid {kind}, ratio double")


def scene_apps(texts: DataFrame, phrases: DataFrame, threshold: int = 80, row_gap: int = 10, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """(frame, app, score, x1, y1, x2, y2, origin_x, origin_y): the applications that a frameset shows.

    phrases: as for grid_scores(), and least, the score that an application has to reach. The best of grid_scores() counts, of
    equal ones the first in reading order; origin is its upper left corner, less the offset.
    """
    s = grid_scores(texts, phrases, threshold, row_gap)
    best = s.groupBy(*FRAME, "app").agg(F.max_by(F.struct("score", "x1", "y1", "x2", "y2"), F.struct("score", -F.col("row"), -F.col("col"))).alias("m"))
    least = phrases.groupBy("app").agg(F.max("least").alias("least"))
    won = best.join(least, "app").where("m.score >= least")
    return won.select(*FRAME, "app", "m.*", (F.col("m.x1") - offset[0]).alias("origin_x"), (F.col("m.y1") - offset[1]).alias("origin_y"))


def compiled(texts: DataFrame, name: str = "app", threshold: int = 80, row_gap: int = 20, most_missed: int = 0) -> DataFrame:
    """A layout, as sifter.sift() takes it, out of several movies of one application, with n_seen and n_missed for each item.

    Each movie is stood for by its screen with the most rows, then texts (sifter.densest_frames), and the one of these with the
    most is the drawn screen. The others are matched to its grid by growth (grid_cells); a text that a movie's
    match doesn't hold is missed by it. What at most most_missed others miss is a label; what none of the others sees is taken for
    an anomaly and left out, unless there are no others; the rest varies between movies: user_data, to be masked.

    Columns: app_id (name, row and column of the drawn screen's grid), type, text, x, y, min_width (null: none), mask_this_field, row_no, row_pos, left_no, left_pos, right_no, right_pos
    (numbers from 1), n_seen, n_missed. Null texts, which can match nothing, count as missed by all. Of movies alike the
    smaller one is drawn. Empty tables give no rows.
    """
    screens = stored(densest_frames(texts, row_gap))
    top = screens.orderBy(F.col("n_rows").desc(), F.col("n_texts").desc(), "movie_url").limit(1).select(*FRAME)
    one = stored(text_grid(texts.join(F.broadcast(top), list(FRAME), "left_semi"), row_gap))
    others = texts.join(screens.join(F.broadcast(top), list(FRAME), "left_anti").select(*FRAME), list(FRAME), "left_semi")
    none = F.lit(None).cast("int")
    phrases = one.select(F.lit(name).alias("app"), F.col("row").alias("row_no"), F.col("col").alias("pos"), "text", none.alias("max_width"), none.alias("max_height"))
    seen = grid_cells(others, phrases, threshold, row_gap).groupBy(F.col("app_row").alias("row"), F.col("app_col").alias("col")).agg(F.count_distinct("movie_url").cast("int").alias("seen"))
    n = screens.count() - 1
    boxes = one.select(*FRAME, "uid", "text", "row", "col", F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("x2 - x1").alias("w"), F.expr("y2 - y1").alias("h"))
    place = lambda kind, name: [F.min(F.when(F.col("kind") == kind, F.col(f"ocr_{of}") + 1)).cast("int").alias(f"{name}_{to}") for of, to in (("row", "no"), ("pos", "pos"))]
    places = grouped_texts(boxes).groupBy("uid").agg(*place("row", "row"), *place("left_col", "left"), *place("right_col", "right"))
    items = boxes.join(seen, ["row", "col"], "left").withColumn("n_seen", F.coalesce("seen", F.lit(0))).withColumn("n_missed", n - F.col("n_seen"))
    items = items.where(F.lit(n == 0) | (F.col("n_seen") > 0)).withColumn("type", F.when(F.col("n_missed") <= most_missed, "label").otherwise("user_data"))
    wide = [F.concat_ws("_", F.lit(name), "row", "col").alias("app_id"), "type", "text", "x", "y", none.alias("min_width"), (F.col("type") == "user_data").alias("mask_this_field")]
    return items.join(places, "uid", "left").select(*wide, "row_no", "row_pos", "left_no", "left_pos", "right_no", "right_pos", "n_seen", "n_missed")
