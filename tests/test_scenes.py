"""Grid growth over phrases beside a plain walk over the whole grids."""

import random

from veilframe.operators import scenes


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return 100 if a == b else round(200.0 * row[-1] / (len(a) + len(b))) if a and b else 0


def plain(texts, apps, threshold, gap):
    """frame -> app -> uid -> (score, box), by the rules, over all cells of both grids."""
    out = {}
    for frame in {t[1] for t in texts}:
        rows, top = [], None
        for t in sorted((t for t in texts if t[1] == frame and None not in t[4:]), key=lambda t: (t[5], t[2])):
            if top is None or t[5] - top > gap:
                rows.append([])
                top = t[5]
            rows[-1].append(t)
        rows = [sorted(r, key=lambda t: (t[4], t[2])) for r in rows]
        for app, (grid, width, height) in apps.items():
            fits = lambda a, b: a is not None and b is not None and ratio(a, b) > threshold
            for r, row in enumerate(rows):
                for c, t in enumerate(row):
                    for i, phrases in enumerate(grid):
                        for k, p in enumerate(phrases):
                            if not fits(t[3], p):
                                continue
                            box, total = [t[4], t[5], t[4] + t[6], t[5] + t[7]], ratio(t[3], p)

                            def take(order, free, p):
                                nonlocal box, total
                                for j, m in order:
                                    o = rows[j][m]
                                    new = [min(box[0], o[4]), min(box[1], o[5]), max(box[2], o[4] + o[6]), max(box[3], o[5] + o[7])]
                                    wide = width is not None and new[2] - new[0] > width or height is not None and new[3] - new[1] > height
                                    if free(j, m) and fits(o[3], p) and not wide:
                                        box, total = new, total + ratio(o[3], p)
                                        return j, m

                            last = (r, c)
                            above = [(j, m) for j in range(r - 1, 0, -1) for m in reversed(range(len(rows[j])))]
                            for q in range(i - 1, 0, -1):
                                for p2 in reversed(grid[q]):
                                    last = take(above, lambda j, m: not (j > last[0] or j == last[0] and m >= last[1]), p2) or last
                            last = (r, c)
                            below = [(j, m) for j in range(r + 1, len(rows)) for m in range(len(rows[j]))]
                            for q in range(i + 1, len(grid)):
                                for p2 in grid[q]:
                                    last = take(below, lambda j, m: not (m <= last[1] and j <= last[0]), p2) or last
                            old = out.setdefault((frame, app), {}).get(t[2])
                            if old is None or total > old[0]:
                                out[frame, app][t[2]] = (total, (i, k), tuple(box), (r, c))
    return out


WORDS = ["Inbox", "Inbix", "Sent", "Send", "Drafts", "Draft", "Trash", "Account", "Acount", "Total", "Totals", "x"]


def tables(spark, seed):
    rng = random.Random(seed)
    texts = [("m", f, 100 * f + 10 * r + c, rng.choice([*WORDS, None]), 60 * c + rng.randrange(8), 40 * r + rng.randrange(14), 50, 20) for f in range(4) for r in range(5) for c in range(5)]
    texts += [("m", 1, 900, "Inbox", None, 3, 5, 5), ("m", 7, 901, None, 1, 1, 5, 5)]
    apps = {a: ([[rng.choice([*WORDS, None]) for _ in range(5)] for _ in range(5)], *size) for a, size in (("mail", (None, None)), ("bank", (190, 120)), ("tall", (100, None)))}
    phrases = [(a, 3 * i + 2, k, p, 250, *size) for a, (grid, *size) in apps.items() for i, row in enumerate(grid) for k, p in enumerate(row)]
    df = spark.createDataFrame(texts, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    return texts, apps, df.withColumn("row", df.x).withColumn("score", df.y), spark.createDataFrame(phrases, "app string, row_no int, pos int, text string, least int, max_width int, max_height int")


def test_grown_like_a_plain_walk(spark):
    for seed in (1, 2, 3):
        texts, apps, df, phrases = tables(spark, seed)
        want = plain(texts, apps, 80, 10)
        got: dict = {}
        for r in scenes.grid_scores(df, phrases).collect():
            got.setdefault((r.frameset, r.app), {})[r.uid] = (r.score, (r.app_row, r.app_col), (r.x1, r.y1, r.x2, r.y2), (r.row, r.col))
        assert got == want and max(len(x) for x in want.values()) > 8
        best = {(r.frameset, r.app): (r.score, (r.x1, r.y1, r.x2, r.y2), (r.origin_x, r.origin_y)) for r in scenes.scene_apps(df, phrases, offset=(3, 4)).collect()}
        first = {k: min(v.values(), key=lambda x: (-x[0], x[3])) for k, v in want.items()}
        assert best == {k: (s, box, (box[0] - 3, box[1] - 4)) for k, (s, _, box, _) in first.items() if s >= 250} and best


def test_known_screen_and_empty_tables(spark):
    p = spark.createDataFrame([("mail", 1, 1, "Head", 150, None, None), ("mail", 2, 1, "Inbox", 150, None, None), ("mail", 3, 1, "Sent", 150, None, None), ("bank", 1, 1, "Account", 100, None, None), ("bank", 2, 1, None, 100, None, None)], "app string, row_no int, pos int, text string, least int, max_width int, max_height int")
    t = [("m", 1, 1, "Inbox", 0, 20, 9, 9), ("m", 1, 2, "Sent", 0, 50, 9, 9), ("m", 1, 3, None, 0, 80, 9, 9), ("m", 2, 4, "Sent", 0, 0, 9, 9), ("m", 2, 5, "Inbox", 50, 20, 9, 9)]
    df = spark.createDataFrame(t, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    assert [tuple(r)[1:] for r in scenes.scene_apps(df, p).collect()] == [(1, "mail", 200.0, 0, 20, 9, 59, 0, 20)]
    assert scenes.scene_apps(df.limit(0), p).count() == 0 and scenes.scene_apps(df, p.limit(0)).count() == 0


def test_matched_cells_belong_to_the_best_match(spark):
    texts, apps, df, phrases = tables(spark, 5)
    best = {(r.frameset, r.app): r.score for r in scenes.scene_apps(df, phrases.withColumn("least", phrases.least * 0)).collect()}
    said, cells = {t[2]: t[3] for t in texts}, {}
    for r in scenes.grid_cells(df, phrases).collect():
        assert ratio(said[r.uid], apps[r.app][0][r.app_row][r.app_col]) == r.ratio > 80
        cells.setdefault((r.frameset, r.app), []).append(r)
    assert {k: sum(r.ratio for r in v) for k, v in cells.items()} == best
    assert all(len({(r.app_row, r.app_col) for r in v}) == len(v) for v in cells.values())


SCREEN = [("Menu", 0, 0), ("Name", 0, 60), ("{}", 200, 62), ("City", 0, 120), ("{}", 200, 121), ("Phone", 0, 180), ("Total", 0, 240)]


def screen(movie, frame, values, some=None, dx=0):
    """The screen with a movie's own values, or only some of its texts."""
    values = iter(values)
    return [(movie, frame, 1000 * frame + k, t.format(next(values)) if t == "{}" else t, x + dx, y, 80, 20) for k, (t, x, y) in enumerate(SCREEN) if some is None or k in some]


def test_compiled_layout(spark):
    from veilframe.operators import sifter

    rows = screen("a", 1, ["Anna Berg", "Oslo"]) + screen("a", 2, ["Anna Berg", "Oslo"], {0, 1, 2}) + [("a", 1, 1900, None, 0, 300, 80, 20), ("a", 1, 1901, "Help", None, 1, 1, 1)]
    rows += screen("b", 3, ["Juan Diez", "Lima"], {0, 1, 2, 3, 4, 5, 6}, 30) + screen("c", 4, ["Wu", "Oslo"], {0, 1, 2, 3, 4, 5, 6})
    df = spark.createDataFrame(rows, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    got = {r.text: r for r in scenes.compiled(df, "form").collect()}
    # "Anna Berg" is nobody else's and is left out; "Oslo" is one other movie's
    assert {t: (r.type, r.n_seen, r.n_missed, r.mask_this_field) for t, r in got.items()} == {
        **{t: ("label", 2, 0, False) for t in ("Menu", "Name", "City", "Phone", "Total")}, "Oslo": ("user_data", 1, 1, True)
    }
    assert (got["City"].app_id, got["City"].x, got["City"].y, got["City"].row_no, got["City"].row_pos) == ("form_2_0", 0, 120, 3, 1)
    assert {t: r.type for t, r in ((r.text, r) for r in scenes.compiled(df, "form", most_missed=1).collect())}["Oslo"] == "label"
    # the layout finds its items in a screen of another movie
    found = {(r.frameset, r.app_id): r.text for r in sifter.sift(df, scenes.compiled(df, "form"), least_total=300).collect()}
    assert found[3, "form_1_0"] == "Name" and found[3, "form_2_1"] == "Lima" and found[4, "form_4_0"] == "Total"
    alone = scenes.compiled(df.where("movie_url = 'b'")).collect()
    assert len(alone) == 7 and {r.type for r in alone} == {"label"} and scenes.compiled(df.limit(0)).count() == 0


def test_texts_go_through_python_once_and_keep_their_own_rows(spark):
    """Before, a screen's rows were found twice and joined back by id, so that texts that share an id got each other's rows."""
    t = [("m", 1, 1, "Inbox", 0, 20, 9, 9), ("m", 1, 1, "Sent", 0, 50, 9, 9), ("m", 1, None, "Sent", 0, 80, 9, 9), ("m", 1, 2, "Sent", 5, 81, 9, 9), (None, 1, 3, "Inbox", 0, 20, 9, 9)]
    df = spark.createDataFrame(t, "movie_url string, frameset long, uid long, text string, x int, y int, w int, h int")
    p = spark.createDataFrame([("mail", 1, 1, "Inbox", None, None), ("mail", 2, 1, "Sent", None, None)], "app string, row_no int, pos int, text string, max_width int, max_height int")
    assert sorted((r.text, r.row, r.col) for r in scenes.text_grid(df).collect() if r.movie_url) == [("Inbox", 0, 0), ("Sent", 1, 0), ("Sent", 2, 0)]
    named = scenes.grid_scores(df.withColumn("uid", df.uid.cast("string")), p)
    assert sorted((r.movie_url or "", r.uid, r.score, r.row, r.app_row) for r in named.collect()) == [("", "3", 100.0, 0, 0), ("m", "1", 200.0, 0, 0), ("m", "2", 100.0, 2, 1)]
    assert named._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
