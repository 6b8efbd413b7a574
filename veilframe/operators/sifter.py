"""The data sifter: recognised text matched with an application's known layout, found places labelled with the layout's items.

layout: app_id, type (label or user_data), text, x, y, mask_this_field, and the item's place in the layout's rows and columns:
row_no, row_pos, left_no, left_pos, right_no, right_pos (numbers from 1; null where it is in none). A layout is a screen's
worth of items; it is counted before tasks get it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators import layout as L
from veilframe.operators.grouped import in_groups
from veilframe.operators.sets import FRAME
from veilframe.operators.texts import similar
from veilframe.sources.shared import stored

KINDS = {"row": ("row_no", "row_pos"), "left_col": ("left_no", "left_pos"), "right_col": ("right_no", "right_pos")}
MOST_ITEMS = 20_000


def grouped_texts(texts: DataFrame) -> DataFrame:
    """(frame, kind, ocr_row, ocr_pos, uid, text): the texts' rows and columns, numbered by where they begin, and the texts
    in them: rows from the left, columns from above."""
    g = L.rows_and_columns(texts)
    t = texts.select(*FRAME, "uid", "text", "x", "y", "w", "h")
    kinds = F.expr("inline(array(struct('row' kind, row leader), struct('left_col' kind, left_col leader), struct('right_col' kind, right_col leader)))")
    rows = g.select(*FRAME, "uid", kinds).join(t, [*FRAME, "uid"])
    lead = t.select(*FRAME, F.col("uid").alias("leader"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.expr("x + w").alias("lr"))
    rows = rows.join(lead, [*FRAME, "leader"]).withColumn("at", F.expr("case kind when 'row' then ly when 'left_col' then lx else lr end"))
    number = F.dense_rank().over(Window.partitionBy(*FRAME, "kind").orderBy("at", "leader")) - 1
    place = F.row_number().over(Window.partitionBy(*FRAME, "kind", "leader").orderBy(F.when(F.col("kind") == "row", F.col("x")).otherwise(F.col("y")), "uid")) - 1
    return rows.select(*FRAME, "kind", number.alias("ocr_row"), place.alias("ocr_pos"), "uid", "text")


class _Layout:
    """A layout in the rows and columns that its items stand in, and its labels by number; bounded by a screen."""

    def __init__(self, rows: list):
        self.items = {r["app_id"]: r for r in rows}
        self.groups: dict = {}
        for kind, (no, pos) in KINDS.items():
            for r in sorted((r for r in rows if r[no] is not None and r[pos] is not None), key=lambda r: (r[no], r[pos], str(r["app_id"]))):
                self.groups.setdefault(kind, {}).setdefault(r[no], []).append(r["app_id"])
        first = next(iter(self.groups.get("row", {}).values()), None)
        self.first_y = (self.items[first[0]]["y"] or 0) if first else 0
        self.labels = sorted({r["text"] for r in rows if r["type"] == "label" and r["text"] is not None})
        #: Where each label stands: by kind and text the rows (columns) and places in them.
        self.stands: dict = {kind: {} for kind in KINDS}
        for r in rows:
            for kind, (no, pos) in KINDS.items():
                if r["type"] == "label" and r["text"] is not None and r[no] is not None and r[pos] is not None:
                    self.stands[kind].setdefault(r["text"], []).append((r[no], r[pos]))
        #: Of each item its cells, in the order of each(), and the cells of its first left column, without one of its first right one.
        self.cells: dict = {}
        self.column: dict = {}
        for kind, no, own in self.each():
            for item in own:
                if (kind, no, item) not in self.cells.setdefault(item, []):
                    self.cells[item].append((kind, no, item))
                if kind != "row":
                    self.column.setdefault(item, (kind, no))

    def each(self, kinds=tuple(KINDS)):
        """(kind, number, items) of every row, then left column, then right column."""
        for kind in kinds:
            for no, own in self.groups.get(kind, {}).items():
                yield kind, no, own


class _Screen:
    """One frameset's texts and what is known of the layout's items: the text of each item in each row and column."""

    def __init__(self, layout: _Layout, texts: list[dict], reach: float):
        self.layout, self.reach = layout, reach
        self.texts = {t["uid"]: t for t in texts}
        cells = sorted((c["kind"], c["app_row"], c["ocr_pos"], t["uid"]) for t in texts for c in t.get("cells") or ())
        self.members: dict = {}  # (kind, number of the layout's row) -> the texts in it
        for kind, no, _, uid in cells:
            self.members.setdefault((kind, no), []).append(uid)
        self.held: dict = {}  # (kind, number, item) -> (uid, how)
        self.own: set = set()  # those not carried over from elsewhere

    def grouped(self) -> dict:
        """By kind the rows (columns) of texts by where they begin, each with its texts in order: as grouped_texts() numbers them."""
        texts, out = self.texts, {}
        for k, (kind, leaders) in enumerate(zip(KINDS, zip(*L.leaders_of(list(texts.values())).values(), strict=True), strict=True)):
            by: dict = {}
            for uid, leader in zip(texts, leaders, strict=True):
                by.setdefault(leader, []).append(uid)
            start = (lambda u: (texts[u]["y"], u), lambda u: (texts[u]["x"], u), lambda u: (texts[u]["x"] + texts[u]["w"], u))[k]
            along = "x" if kind == "row" else "y"
            out[kind] = [sorted(by[u], key=lambda u: (texts[u][along], u)) for u in sorted(by, key=start)]
        return out

    def match_groups(self, threshold: int, least_total: int) -> bool:
        """Rows and columns matched with the layout's, for the largest total of each kind; whether all totals together are enough."""
        totals = 0
        for kind, groups in self.grouped().items():
            stands, cells = self.layout.stands[kind], []
            for row, uids in enumerate(groups):
                for pos, uid in enumerate(uids):
                    for label, ratio in zip(self.texts[uid]["labels"] or (), self.texts[uid]["ratios"] or (), strict=True):
                        cells += [(row, no, app_pos, pos, ratio) for no, app_pos in stands.get(label, ())]
            best = L.best_rows(L.quick_rows(cells, threshold)) if cells else []
            for no, row, score, _ in best:
                if score > 0:
                    self.members[kind, no] = groups[row]
            totals += best[0][3] if best else 0
        return bool(self.members) and totals >= least_total

    def match_rows(self):
        """Items of a matched row or column take its texts in order: user data the first that is wide enough, labels the last
        similar one; what follows begins behind as many texts as were passed."""
        for (kind, no), members in self.members.items():
            base = 0
            for item in self.layout.groups.get(kind, {}).get(no, ()):
                spec = self.layout.items[item]
                for i, uid in enumerate(members[base:]):
                    t = self.texts[uid]
                    if spec["type"] == "label" and spec["text"] in (t["labels"] or ()):
                        base += i + 1
                        self.held[kind, no, item] = (uid, kind)
                    elif spec["type"] == "user_data" and (t["w"] or 0) >= (spec["min_width"] or 0):
                        base += i + 1
                        self.held[kind, no, item] = (uid, kind)
                        break
        self.own |= set(self.held)

    def found(self) -> dict:
        """Of each item found anywhere its text: the one in the last right column, else left column, else row."""
        items = dict.fromkeys(item for _, _, item in self.held)
        return {item: next(self.held[c] for c in reversed(self.layout.cells[item]) if c in self.held) for item in items}

    def carry(self):
        """What is found in one row or column holds for all others that the item stands in and that have nothing for it."""
        for item, text in self.found().items():
            for cell in self.layout.cells[item]:
                self.held.setdefault(cell, text)

    def scale(self) -> tuple[float, float]:
        """Vertical scale and origin: the mean over the rows of how far they lie below the first found one, found against drawn."""
        tops = []
        for kind, no, own in self.layout.each(("row",)):
            some = next((i for i in own if (kind, no, i) in self.held), None)
            if some is not None:
                tops.append((self.layout.items[some]["y"], self.texts[self.held[kind, no, some][0]]["y"]))
        steps = [(o - tops[0][1]) / (a - tops[0][0]) for a, o in tops[1:] if a != tops[0][0]]
        if not steps:
            return 1.0, 0.0
        scale = sum(steps) / len(steps)
        return scale, tops[0][1] - (tops[0][0] - self.layout.first_y) * scale

    def column_at(self, kind: str, no: int) -> tuple[float, bool] | None:
        """Where a column was found, and whether that is a left edge."""
        uid = next((self.held[kind, no, i][0] for i in self.layout.groups[kind][no] if (kind, no, i) in self.held), None)
        t = self.texts.get(uid)
        x = (t["x"] + (t["w"] if kind == "right_col" else 0)) if t else 0
        return (x, kind == "left_col") if x else None

    def claim_near(self):
        """Items of rows that are not found yet take the nearest free text, if it is near enough to where their column and the
        scale put them; one after the other."""
        free = {u: t for u, t in self.texts.items() if u not in {uid for uid, _ in self.held.values()}}
        if not free:
            return
        scale, origin = self.scale()
        columns = {c: self.column_at(*c) for c in set(self.layout.column.values())}  # only rows change below
        for kind, no, own in self.layout.each(("row",)):
            for item in own:
                at = None if (kind, no, item) in self.held else columns.get(self.layout.column.get(item))
                if at is None or self.layout.items[item]["y"] is None:
                    continue
                y = int((self.layout.items[item]["y"] - self.layout.first_y) * scale) + origin
                best = min((((t["x"] + (0 if at[1] else t["w"]) - at[0]) ** 2 + (t["y"] - y) ** 2) ** 0.5, u) for u, t in free.items())
                if best[0] <= self.reach:
                    del free[best[1]]
                    self.held[kind, no, item] = (best[1], "near")
                    self.own.add((kind, no, item))
                    if not free:
                        return

    def confirm(self):
        """(item, uid, text, how, carried) of all found items."""
        self.match_rows()
        self.carry()
        self.claim_near()
        self.carry()
        carried: dict = {}
        for cell in self.held:
            carried[cell[2]] = carried.get(cell[2], 0) + (cell not in self.own)
        return [(item, uid, self.texts[uid]["text"], how, carried[item]) for item, (uid, how) in sorted(self.found().items(), key=lambda x: str(x[0]))]


def sift(texts: DataFrame, layout: DataFrame, *, threshold: int = 70, least_total: int = 500, reach: float = 200.0) -> DataFrame:
    """(frame, app_id, uid, text, how, carried): the items of a layout found among a frameset's texts (uid: unique in a frameset).

    Texts are grouped into rows and columns, each scored against the layout's by the labels that they have in order, and
    matched so that later ones follow later ones, for the largest total. Framesets whose totals of rows, left and right
    columns together reach least_total show the application, and are confirmed, one screen at a time:

    1. items of matched rows and columns take the texts in them (match_rows)
    2. what was found in one row or column holds in the others that the item stands in (carry)
    3. items of rows that are still missing take the nearest free text within reach of where their column and the rows' scale
       put them (claim_near; a column at x = 0 counts as unknown)
    4. and these, too, are carried to the columns.

    how: the row, left_col or right_col that found the text that counts (of several the last right column's, then the last left
    column's), or near; carried: in how many of the item's rows and columns it stands only since step 2 or 4. layout may have
    min_width, the least width of user data. Null texts match no label; texts and items with null places are left out of
    step 3's distances. Framesets without a match, and empty tables, give no rows.

    Texts are shuffled once, by frameset, each with the numbers and ratios of the labels that it is similar to.
    """
    names = ["app_id", "type", "text", "x", "y", *[c for k in KINDS.values() for c in k]]
    rows = layout.select(*names, (F.col("min_width") if "min_width" in layout.columns else F.lit(None).cast("int")).alias("min_width")).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a layout has more than {MOST_ITEMS} items")
    spec = _Layout([r.asDict() for r in rows])
    phrases = texts.sparkSession.createDataFrame(list(enumerate(spec.labels)), "n int, phrase string")
    alike = similar(texts.select("text"), phrases, threshold - 1).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "ratio"))).alias("l"))
    alike = stored(alike.select("text", F.col("l.n").alias("labels"), F.col("l.ratio").alias("ratios")))
    t = texts.where(L.BOX).where("movie_url is not null and frameset is not null").select(*FRAME, "uid", "text", "x", "y", "w", "h").join(alike, "text", "left")
    types = dict(texts.dtypes)["uid"], dict(layout.dtypes)["app_id"]

    def run(rows):
        rows = [r | {"labels": [spec.labels[k] for k in r["labels"] or ()]} for r in rows]
        if not any(r["labels"] for r in rows):
            return []
        screen = _Screen(spec, rows, reach)
        return screen.confirm() if screen.match_groups(threshold, least_total) else []

    return in_groups(t, list(FRAME), ["uid"], run, f"app_id {types[1]}, uid {types[0]}, text string, how string, carried int")


def densest_frames(texts: DataFrame, threshold: int = 10) -> DataFrame:
    """(movie_url, frameset, n_rows, n_texts): each movie's frameset with the most rows of text, then the most texts, then the smallest."""
    rows = L.bunched(texts, threshold).groupBy(*FRAME).agg(F.max("bunch").alias("b"), F.count("*").alias("n_texts")).withColumn("n_rows", F.col("b") + 1)
    best = rows.groupBy("movie_url").agg(F.min_by(F.struct("frameset", "n_rows", "n_texts"), F.struct(-F.col("n_rows"), -F.col("n_texts"), "frameset")).alias("m"))
    return best.select("movie_url", "m.*")


def seldom_seen(texts: DataFrame, threshold: int = 70) -> DataFrame:
    """(text, n_missed): the texts of the densest frame of all movies, and how many of the other movies have nothing similar in theirs.

    Texts that others miss are a client's own data, those that all have are labels. The densest frames and their texts, which all else is
    made of, are found once and written to the shared folder.
    """
    dense = stored(densest_frames(texts))
    top = dense.orderBy(F.col("n_rows").desc(), F.col("n_texts").desc(), "movie_url").limit(1)
    own = stored(texts.join(dense.select(*FRAME), list(FRAME), "left_semi").where("text is not null").select("movie_url", "text").distinct())
    best = own.join(top.select("movie_url"), "movie_url", "left_semi").select("text").distinct()
    others = own.join(top.select("movie_url"), "movie_url", "left_anti")
    pairs = similar(others.select("text"), best.select(F.col("text").alias("phrase")), threshold - 1)
    seen = others.join(pairs.select("text", "phrase"), "text").groupBy(F.col("phrase").alias("text")).agg(F.count_distinct("movie_url").alias("n"))
    n_others = others.select("movie_url").distinct().count()
    return best.join(seen, "text", "left").select("text", (F.lit(n_others) - F.coalesce("n", F.lit(0))).alias("n_missed"))


def both(a: tuple, b: tuple) -> tuple:
    """The smallest box that holds both."""
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def grown_together(areas: list[tuple], least_overlap: int) -> list[tuple]:
    """One after the other, an area takes in every other one that it overlaps by more than least_overlap pixels, and both become
    what holds the two."""
    areas = list(areas)
    inside = lambda p, q: any(q[0] <= x <= q[2] and q[1] <= y <= q[3] for x, y in ((p[0], p[1]), (p[2], p[3])))
    for i in range(len(areas)):
        for j in range(len(areas)):
            a, b = areas[i], areas[j]
            if i == j or a == b:
                continue
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w >= 0 and h >= 0 and w * h > least_overlap and (inside(a, b) or inside(b, a)):
                areas[i] = areas[j] = both(a, b)
    return areas


def app_areas(texts: DataFrame, least_overlap: int = 25, least_width: int = 100, least_height: int = 50) -> DataFrame:
    """(frame, x1, y1, x2, y2, n_texts, phrases): areas that texts' neighbourhoods (nx1, ny1, nx2, ny2) grow together to.

    Taken in order of uid, a text's neighbourhood takes in every other one that it overlaps by more than least_overlap pixels, and
    both become what holds the two. Texts with the same area in the end are one application; areas of one text alone and narrow
    or low ones are left out. phrases: its texts by uid, joined by line ends.
    """

    def grow(rows):
        rows = list(rows)
        areas = grown_together([(r["nx1"], r["ny1"], r["nx2"], r["ny2"]) for r in rows], least_overlap)
        by: dict = {}
        for r, a in zip(rows, areas, strict=True):
            by.setdefault(a, []).append(r["text"] or "")
        for a, own in sorted(by.items()):
            if len(own) > 1 and a[2] - a[0] >= least_width and a[3] - a[1] >= least_height:
                yield (*a, len(own), "\n".join(own))

    rows = texts.where("nx1 is not null and ny1 is not null and nx2 is not null and ny2 is not null").select(*FRAME, "uid", "text", "nx1", "ny1", "nx2", "ny2")
    return in_groups(rows, list(FRAME), ["uid"], grow, "x1 int, y1 int, x2 int, y2 int, n_texts int, phrases string")
