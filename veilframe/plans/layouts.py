"""Queries over recognised text and frames in order: changes, clocks, rows and grids, layouts, colours, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators import applications, detector, erase, features, focus, frames, grower, images, layout, pixels, scenes, scores, screens, sets, sifter, templates, texts
from veilframe.plans.registry import plain, query
from veilframe.sources import recordings
from veilframe.sources import tables as S
from veilframe.sources.shared import new_folder, stored

M, FR = S.MATCHES_SQL, S.FRAMES_SQL
LCS = """(list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda old, i: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda nw, j: list_append(nw,
  case when substr(a, i[1], 1) = substr(b, j[1], 1) then old[j[1]] + 1 else greatest(old[j[1] + 1], nw[j[1]]) end), [0::bigint]), list_transform(range(0, length(b) + 1), lambda z: 0::bigint)))[-1]"""


@query(f"""with {M}, o as (select movie_url, frameset, row_number() over (partition by movie_url order by frameset) place from (select distinct movie_url, frameset from m)), k as (select m.*, place from m join o using (movie_url, frameset)),
h as (select c.movie_url, c.frameset, c.place, b.uid b_uid, c.uid, b.text a, c.text b from k b join k c on b.movie_url = c.movie_url and c.place = b.place + 1 and b.x + b.w // 2 between c.x and c.x + c.w and b.y + b.h // 2 between c.y and c.y + c.h),
l as (select * from h qualify row_number() over (partition by movie_url, place, b_uid order by uid desc) = 1), r as (select *, cast(round_even(100 * (2.0::double * {LCS} / (length(a) + length(b))), 0) as int) < 70 altered from l),
u as (select movie_url, place, uid, bool_or(altered) altered from r group by all)
select k.movie_url, k.frameset, k.uid, case when altered then 'altered' else 'new' end state from k left join u using (movie_url, place, uid) where altered is null or altered
union all select b.movie_url, o.frameset, b.uid, 'disappeared' from k b join o on o.movie_url = b.movie_url and o.place = b.place + 1 where not exists (select 1 from l where l.movie_url = b.movie_url and l.place = b.place + 1 and l.b_uid = b.uid)""")
def t7_focus(spark, d):
    return focus.changed_text(S.matches(spark, d))


@query(f"""with {M}, s as (select *, case when x + w // 2 between 0 and 899 then 0 when x + w // 2 between 900 and 1999 then 1 end s from m), c as (select movie_url, frameset, s, count(*) n from s group by all),
b as (select movie_url, frameset, arg_max(s, row(n, -s)) best, count(*) used from c group by all) select uid, frameset from s join b using (movie_url, frameset) where used = 1 or s = best""")
def t7b_single_screen(spark, d):
    m = S.matches(spark, d)
    screens = spark.createDataFrame([(0, 0, 0, 899, 4000), (1, 900, 0, 1999, 4000)], "screen int, x1 int, y1 int, x2 int, y2 int")
    return focus.on_one_screen(m, m.select(*sets.FRAME).distinct().join(F.broadcast(screens), F.lit(True))).select("uid", "frameset")


@query(f"with {M} select movie_url, frameset, min(x) x1, min(y) y1, max(x + w) x2, max(y + h) y2 from m where scanner_type = 'A' group by all")
def t7c_windows(spark, d):
    return focus.effective_windows(S.matches(spark, d).where("scanner_type = 'A'"))


@plain
def t7a_hotspots(spark, d):
    """Matches that don't lie where a movie changes all the time."""
    return focus.without_hotspots(S.matches(spark, d), 1920, 1080).select("movie_url", "frameset", "uid")


CLOCK = f"{FR}, c as (select movie_url, row_number() over (partition by movie_url order by ts, event_id) - 1 place, case when value < 90 then floor(value)::int % 60 end \"minute\" from f)"


@query(f"""with {CLOCK}, l as (select *, lag("minute") over (partition by movie_url order by place) b from c), r as (select movie_url, min(place) place, arg_min("minute", place) m from l where "minute" = b + 1 or "minute" = 0 and b = 59 group by all)
select movie_url, place, (((m * 60 - place) % 3600 + 3600) % 3600 // 60)::int "minute", (((m * 60 - place) % 3600 + 3600) % 3600 % 60)::int "second" from r""")
def win3_rollover(spark, d):
    clock = frames.numbered(S.frames(spark, d)).selectExpr("movie_url", "frame_seq place", "case when value < 90 then cast(floor(value) as int) % 60 end minute")
    return focus.roll_over(clock)


@query("""with t as (select user_id % 10 movie_url, event_id ord, case when event_id % 7 = 0 then 'at ' || (event_id % 12) || ':0' || (event_id % 6) || ':10 PM' else event_type end "text" from events),
h as (select movie_url, arg_min("text", ord) t from t where regexp_matches("text", '\\d+:\\d+:\\d+ [A|P]M') group by all) select 'm' || movie_url movie_url, regexp_extract(t, '(\\d+):(\\d+):(\\d+) ([A|P])M', 1) "hour", regexp_extract(t, '(\\d+):(\\d+):(\\d+) ([A|P])M', 2) "minute", regexp_extract(t, '(\\d+):(\\d+):(\\d+) ([A|P])M', 3) "second", regexp_extract(t, '(\\d+):(\\d+):(\\d+) ([A|P])M', 4) || 'M' am_pm from h""")
def t13_blue_screen(spark, d):
    t = S.table(spark, d, "events").selectExpr("concat('m', user_id % 10) movie_url", "event_id ord", "case when event_id % 7 = 0 then concat('at ', event_id % 12, ':0', event_id % 6, ':10 PM') else event_type end text")
    return focus.blue_screen_time(t)


@query(f"""with {CLOCK}, l as (select *, lag("minute") over (partition by movie_url order by place) b from c), r as (select movie_url, min(place) place, arg_min("minute", place) m from l where "minute" = b + 1 or "minute" = 0 and b = 59 group by all),
t as (select 'm' || (user_id % 10) movie_url, event_id ord, (event_id % 12) h, (event_id % 6) q from events where event_id % 7 = 0), h as (select movie_url, arg_min(h, ord)::int "hour", arg_min(q, ord)::int "minute" from t group by all)
select movie_url, "hour", "minute", 10 "second", 'PM' am_pm, 'blue_screen' how from h union all
select movie_url, null::int, (((m * 60 - place) % 3600 + 3600) % 3600 // 60)::int, (((m * 60 - place) % 3600 + 3600) % 3600 % 60)::int, null, 'taskbar' from r where movie_url not in (select movie_url from h)""")
def t13_start_times(spark, d):
    """When recordings began, by blue screens and, where there are none, by taskbars."""
    t = S.table(spark, d, "events").selectExpr("concat('m', user_id % 10) movie_url", "event_id ord", "case when event_id % 7 = 0 then concat('at ', event_id % 12, ':0', event_id % 6, ':10 PM') else event_type end text")
    clock = frames.numbered(S.frames(spark, d)).selectExpr("movie_url", "frame_seq place", "1 ord", "case when value < 90 then concat('l0.', lpad(cast(floor(value) as int) % 60, 2, '0'), ' PM') else 'no clock' end text")
    return focus.start_times(t, clock)


@query("""with e as (select 'm' || (vec_id % 20) movie_url, vec_id // 20 place, list_transform(range(1, 65), lambda i: floor((embedding[i]::double + 1) * 127)::int % 256) g from embeddings), b as (select *, lag(g) over (partition by movie_url order by place) q from e)
select movie_url, place, list_transform(range(1, 65), lambda i: greatest(q[i] - g[i], 0))::varchar difference from b where q is not null""")
def t11_difference(spark, d):
    """What each small image has lost in brightness since the one before it."""
    f = _images(spark, d).selectExpr("concat('m', image % 20) movie_url", "image div 20 place", "grey")
    out = pixels.frame_difference(f).where("difference is not null")
    return out.select("movie_url", "place", F.concat(F.lit("["), F.array_join(F.col("difference").cast("array<string>"), ", "), F.lit("]")).alias("difference"))


@query(f"with {FR}, t as (select * from f where value > 20), b as (select *, lag(frameset) over (partition by movie_url order by ts, event_id) before from t) select event_id, frameset, before from b where before is null or before <> frameset")
def win1_skip_empty(spark, d):
    return frames.changes(S.frames(spark, d).where("value > 20")).select("event_id", "frameset", "before")


@query(f"with {M}, y as (select distinct movie_url, frameset, y from m) select * from (select movie_url, frameset, y, y - lag(y) over (partition by movie_url, frameset order by y) gap from y) where gap is not null")
def win5_gaps(spark, d):
    return layout.gaps(S.matches(spark, d), list(sets.FRAME), "y")


@query(f"""with {M}, e as (select movie_url, frameset, 'x' axis, x v from m union all select movie_url, frameset, 'x', x + w from m union all select movie_url, frameset, 'y', y from m), t as (select movie_url, frameset, axis, greatest(ceil(max(v) / 50) - 1, 0) top from e group by all)
select movie_url, frameset, axis, least(v // 50, top)::bigint bin, count(*) n from e join t using (movie_url, frameset, axis) group by all having count(*) >= 2""")
def t5d_bins(spark, d):
    return layout.histogram(S.matches(spark, d), 50, 2).withColumn("bin", F.col("bin").cast("long"))


@plain
def t6a_rows_columns(spark, d):
    """Rows and columns of each frameset's texts, by their leaders."""
    return layout.rows_and_columns(S.matches(spark, d), misalign=60)


def _row_pairs(spark, d):
    """Texts of job_0 against those of job_1 as rows of a layout: numbers, places and ratios."""
    m = S.matches(spark, d)
    place = lambda k: m.where(f"job_id = 'job_{k}'").withColumn("pos", F.row_number().over(Window.partitionBy(*sets.FRAME).orderBy("y", "uid")).cast("int"))
    a, b = place(0), place(1)
    return a.selectExpr("movie_url", "frameset", "pos ocr_pos", "pos % 3 ocr_row", "uid").join(b.selectExpr("movie_url", "frameset", "pos app_pos", "pos % 2 app_row", "uid other"), list(sets.FRAME)).withColumn("ratio", F.expr("cast((uid + other) % 101 as int)"))


@plain
def t6b_quick_scores(spark, d):
    """How well rows of text fit rows of a layout."""
    return layout.quick_scores(_row_pairs(spark, d), 40)


@plain
def t6c_assignment(spark, d):
    """The best rising match of rows of text with rows of a layout."""
    return layout.assigned_rows(layout.quick_scores(_row_pairs(spark, d), 40))


@query(f"""with {M}, t as (select movie_url, frameset, uid, x app_top, 2 * x + y % 7 ocr_top, first_value(x) over w a0, first_value(2 * x + y % 7) over w o0, row_number() over w n from m window w as (partition by movie_url, frameset order by uid)),
g as (select movie_url, frameset, avg((ocr_top - o0) / (app_top - a0)) filter (where n > 1 and app_top <> a0) s, min(a0) a0, min(o0) o0 from t group by all) select movie_url, frameset, round(coalesce(s, 1), 6) scale, round(case when s is null then 0 else o0 - (a0 - 5) * s end, 6) origin from g""")
def t6e_scale(spark, d):
    tops = S.matches(spark, d).selectExpr("movie_url", "frameset", "uid ord", "x app_top", "2 * x + y % 7 ocr_top")
    return layout.vertical_scale(tops, 5).select(*sets.FRAME, F.round("scale", 6).alias("scale"), F.round("origin", 6).alias("origin"))


@plain
def t6f_neighbours(spark, d):
    """Texts that the places of a layout claim, the nearest free ones first come first served."""
    m = S.matches(spark, d)
    wanted = m.where("job_id = 'job_0'").selectExpr("movie_url", "frameset", "uid ord", "uid item", "x + 30 x", "y + 20 y", "case when uid % 2 = 0 then 'left' else 'right' end side")
    return layout.claimed_neighbours(wanted, m.where("job_id <> 'job_0'"))


@query(f"with {M} select uid, case when uid % 101 >= 70 then '' else \"text\" end \"text\" from m where scanner_type = 'A'")
def t6h_masked(spark, d):
    items = S.matches(spark, d).withColumn("mask_this_field", F.col("scanner_type") == "A").withColumn("empty_ratio", F.expr("uid % 101"))
    return layout.masked_fields(items).select("uid", "text")


@plain
def t6i_synthetic(spark, d):
    """A made-up value for each item, by its kind."""
    kinds = list(layout.FORMS) + ["unknown"]
    items = S.table(spark, d, "part").select(F.col("p_partkey").alias("app_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), F.expr(f"cast(p_partkey % {len(kinds)} + 1 as int)")).alias("synthetic_datatype"))
    return layout.with_synthetic(items)


@query(f"""with {M}, w as (select distinct movie_url, frameset, uid from (select movie_url, frameset, uid, unnest(string_split_regex(lower("text"), '[^a-z0-9]+')) word from m) where word <> '' and word not in (select distinct split_part(p_name, ' ', 1) from part where p_partkey % 2 = 0 union select split_part(p_name, ' ', 2) from part where p_partkey % 3 = 0)),
n as (select *, count(*) over (partition by movie_url, frameset, x // 100) nl, count(*) over (partition by movie_url, frameset, (x + w) // 100) nr from m)
select n.uid, n.frameset, case when w.uid is null then 'label' else 'user_data' end \"type\", case when nr > nl then 'right' else 'left' end side from n left join w using (movie_url, frameset, uid)""")
def t6j_compiled(spark, d):
    words = S.table(spark, d, "part").selectExpr("case when p_partkey % 2 = 0 then split_part(p_name, ' ', 1) end word").unionByName(S.table(spark, d, "part").selectExpr("case when p_partkey % 3 = 0 then split_part(p_name, ' ', 2) end word")).where("word is not null")
    lines = S.matches(spark, d).withColumn("left_col", F.expr("x div 100")).withColumn("right_col", F.expr("(x + w) div 100"))
    return layout.compiled_layout(lines, words).select("uid", "frameset", "type", "side")


@plain
def win4_bunches(spark, d):
    """Rows of text, begun anew where a text is too far below the row's first one."""
    return layout.bunched(S.matches(spark, d), 150)


@plain
def t5e_spacing(spark, d):
    """The dominant distance between the rows of a movie's texts."""
    at = S.matches(spark, d).selectExpr("movie_url", "frameset", "cast(y div 20 * 20 as int) at")
    return layout.row_spacing(at, list(sets.FRAME), "at")


@plain
def t5f_grid_areas(spark, d):
    """Areas grown over the grid of the texts below them."""
    m = S.matches(spark, d)
    at = m.selectExpr("movie_url", "frameset", "cast(y div 20 * 20 as int) at")
    return layout.grid_areas(m.where("job_id = 'job_0'"), m.selectExpr("movie_url", "frameset", "x at"), layout.row_spacing(at, list(sets.FRAME), "at"), tie=True)


@plain
def t9b_suppressed(spark, d):
    """Boxes that no better one covers by over 30 %."""
    wide = S.matches(spark, d).withColumn("score", F.expr("uid % 97")).withColumn("w", F.expr("w * 20")).withColumn("h", F.expr("h * 20"))
    return layout.suppressed(wide).select("movie_url", "frameset", "uid")


@query("""with l as (select user_id % 20 log_id, event_id, date_trunc('second', ts) at_ts, event_type from events), t as (select *, epoch(at_ts)::bigint - min(epoch(at_ts)::bigint) over (partition by log_id) s from l)
select event_id, s % 86400 - 30 "second" from t where event_type in ('click', 'purchase') and s % 86400 >= 30""")
def t14_offset(spark, d):
    lines = S.table(spark, d, "events").selectExpr("user_id % 20 log_id", "event_id", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_type) line")
    return texts.frames_of_log(lines, "click|purchase", 30).select("event_id", "second")


PIX = "c as (select l_orderkey % 50 image, (l_partkey * 7) % 256 b, (l_suppkey * 13) % 256 g, (l_linenumber * 31) % 256 r from lineitem)"


def _pixels(spark, d):
    return S.table(spark, d, "lineitem").selectExpr("l_orderkey % 50 image", "(l_partkey * 7) % 256 b", "(l_suppkey * 13) % 256 g", "(l_linenumber * 31) % 256 r")


@query(f"with {PIX}, k as (select image, b // 8 kb, g // 8 kg, r // 8 kr, count(*) n from c group by all) select image, (kb * 8 + 4)::int b, (kg * 8 + 4)::int g, (kr * 8 + 4)::int r, n from k qualify row_number() over (partition by image order by n desc, kb, kg, kr) = 1")
def agg22_dominant_colour(spark, d):
    return pixels.dominant_colour(_pixels(spark, d))


@query(f"with {PIX} select image, (b // 64 * 64)::int b, (g // 64 * 64)::int g, (r // 64 * 64)::int r, 110 tolerance, count(*) n from c group by all having count(*) >= 8")
def t18_colour_ranges(spark, d):
    return pixels.colours(_pixels(spark, d), 4, 8)


@query(f"with {PIX}, k as (select image, b // 8 kb, g // 8 kg, r // 8 kr, count(*) n from c group by all) select * from (select *, row_number() over (partition by image order by n desc, kb, kg, kr) place from k) where place <= 20")
def lim3_top_colours(spark, d):
    cells = pixels.colour_bins(_pixels(spark, d), 32).select("image", *[F.col(f"k{c}").cast("long").alias(f"k{c}") for c in "bgr"], "n")
    return cells.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(F.col("n").desc(), "kb", "kg", "kr"))).where("place <= 20")


@plain
def agg23_colour_groups(spark, d):
    """Each image's fullest colours, like ones together."""
    return pixels.colour_groups(_pixels(spark, d), share=0.0)


GREY = "list_transform(range(1, 65), lambda i: floor((embedding[i]::double + 4) * 32)::int % 256)"


@query(f"""with e as (select vec_id, {GREY} g from embeddings), t as (select vec_id, list_filter(range(0, 3), lambda i: ((g[2 * 8 + 3 + 1] - g[2 * 8 + i + 1]) % 256 + 256) % 256 > 5) l, list_filter(range(3, 8), lambda i: ((g[20] - g[2 * 8 + i + 1]) % 256 + 256) % 256 > 5) r,
list_filter(range(0, 2), lambda i: ((g[20] - g[i * 8 + 4]) % 256 + 256) % 256 > 5) u, list_filter(range(2, 8), lambda i: ((g[20] - g[i * 8 + 4]) % 256 + 256) % 256 > 5) o from e)
select vec_id, coalesce(list_max(l), 0)::int x1, coalesce(list_max(u), 0)::int y1, coalesce(list_min(r), 11)::int x2, coalesce(list_min(o), 10)::int y2 from t""")
def t3b_arrow(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, v -> cast(floor((cast(v as double) + 4) * 32) as int) % 256)").alias("grey"))
    return e.select("vec_id", pixels.arrow_area("grey", 8, 8, 3, 2).alias("a")).select("vec_id", "a.*")


@plain
def t3a_flood(spark, d):
    """The box of the like pixels around the middle of each small image."""
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.expr("transform(embedding, v -> cast(floor((cast(v as double) + 4) * 32) as int) % 256)").alias("grey"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return pixels.flood_areas(e, 3, 3, 20)


@query("select vec_id, list_aggregate(list_transform(range(0, 14), lambda k: printf('%x', list_sum(list_transform(range(0, 4), lambda b: case when embedding[((k * 4 + b) // 7) * 8 + (k * 4 + b) % 7 + 2] > embedding[((k * 4 + b) // 7) * 8 + (k * 4 + b) % 7 + 1] then (8 >> b) else 0 end))::bigint)), 'string_agg', '') hash from embeddings")
def hsh1_hex(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", pixels.frame_hash("embedding").alias("hash"))


@query(f"with {M} select movie_url, \"text\" phrase, string_agg(((uid % 101)::int)::varchar, ',' order by frameset, uid) series from m group by all")
def agg10_ocr_series(spark, d):
    m = S.matches(spark, d).withColumn("percent", F.expr("cast(uid % 101 as int)"))
    return scores.series(m, ["movie_url", "text"], ["frameset", "uid"], "percent").select("movie_url", F.col("text").alias("phrase"), F.array_join("series", ",").alias("series"))


@query(f"with {M}, c as (select job_id, scanner_type, count(*) n from m group by all) select job_id anchor, arg_max(scanner_type, row(n, scanner_type)) most, max(n) n from c group by all")
def agg11_mode(spark, d):
    return scores.most_frequent(S.matches(spark, d).withColumnRenamed("job_id", "anchor"), ["anchor"], "scanner_type").select("anchor", F.col("value").alias("most"), "n")


@query(f"with {M} select movie_url, frameset, string_agg(uid::varchar, ',' order by uid) friends from m where scanner_type = 'A' group by all")
def agg12_grower_series(spark, d):
    return scores.series(S.matches(spark, d).where("scanner_type = 'A'"), list(sets.FRAME), ["uid"], "uid").select(*sets.FRAME, F.array_join(F.col("series").cast("array<string>"), ",").alias("friends"))


@query(f"with {M} select movie_url, frameset, uid, row_number() over (partition by movie_url, frameset order by w * h desc, uid) place from m")
def ord3_popular_cells(spark, d):
    return scores.by_interest(S.matches(spark, d).withColumn("interest", F.expr("w * h"))).select(*sets.FRAME, "uid", "place")


@query("select p_partkey id, row_number() over (partition by p_brand order by p_name, p_partkey) place from part")
def ord4_by_name(spark, d):
    p = S.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("place"))


@query("select p_partkey id, 'rec' || p_partkey recording, 'txn ' || p_size \"transaction\" from part where p_partkey % 4 <> 3")
def prj5_mappings(spark, d):
    lines = S.table(spark, d, "part").selectExpr("p_partkey id", "case p_partkey % 4 when 3 then 'no mapping' when 2 then concat('x (\\'rec', p_partkey, '\\', \\'txn ', p_size, '\\')') else concat(' rec', p_partkey, ' : txn ', p_size) end text")
    return texts.mappings(lines).select("id", "recording", "transaction")


@query("select p_partkey id, '{\"size\":' || p_size || '}' nested from part")
def prj4_csv_ready(spark, d):
    p = S.table(spark, d, "part").selectExpr("p_partkey id", "named_struct('size', p_size) nested")
    return texts.csv_ready(p)


def _layout(spark, d):
    """A layout from the names that are most frequent: a grid of labels and fields."""
    names = S.table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_name").limit(24)
    k = F.row_number().over(Window.orderBy("p_name")) - 1
    rows = names.select(F.concat(F.lit("item"), k.cast("string")).alias("app_id"), k.alias("k"), F.col("p_name").alias("text"))
    return rows.selectExpr(
        "app_id", "case when k % 5 = 4 then 'user_data' else 'label' end type", "text", "cast(100 + k % 3 * 300 as int) x", "cast(50 + k div 3 * 40 as int) y", "k % 2 = 0 mask_this_field",
        "cast(k div 3 + 1 as int) row_no", "cast(k % 3 + 1 as int) row_pos", "cast(k % 3 + 1 as int) left_no", "cast(k div 3 + 1 as int) left_pos", "cast(k % 3 + 1 as int) right_no", "cast(k div 3 + 1 as int) right_pos",
    )


@plain
def t6_sift(spark, d):
    """The items of a layout that are found in each frameset."""
    return sifter.sift(S.matches(spark, d), _layout(spark, d), least_total=100).drop("carried")


@plain
def t6d_confirmed(spark, d):
    """Items of a layout whose text was carried over from another row or column, or claimed by its place."""
    found = sifter.sift(S.matches(spark, d), _layout(spark, d), least_total=100)
    return found.where("carried > 0 or how = 'near'")


@plain
def t6k_seldom_seen(spark, d):
    """Texts of the densest frame, and how many other movies don't have them."""
    return sifter.seldom_seen(S.matches(spark, d))


@plain
def t6k_compiled(spark, d):
    """A layout out of the densest screens of all movies."""
    return scenes.compiled(S.matches(spark, d), "part")


def _phrases(spark, d):
    """Two applications' grids of phrases out of the layout's texts; the second one has a largest extent."""
    return _layout(spark, d).selectExpr("case when row_no % 2 = 0 then 'mail' else 'bank' end app", "row_no", "row_pos pos", "text", "150 least", "case when row_no % 2 = 1 then 900 end max_width", "case when row_no % 2 = 1 then 600 end max_height")


@plain
def t15a_grid_scores(spark, d):
    """What grows from every text of a frameset over the phrases of two applications."""
    return scenes.grid_scores(S.matches(spark, d), _phrases(spark, d), 60, row_gap=150)


@plain
def t15_scene_apps(spark, d):
    """Applications whose phrases a frameset shows."""
    return scenes.scene_apps(S.matches(spark, d), _phrases(spark, d), 60, row_gap=150)


@plain
def t16_app_areas(spark, d):
    """Areas that the texts of a frameset grow together to."""
    m = S.matches(spark, d).selectExpr("movie_url", "frameset", "uid", "text", "x - 200 nx1", "y - 200 ny1", "x + w + 200 nx2", "y + h + 200 ny2")
    return sifter.app_areas(m)


@plain
def t16_movie_apps(spark, d):
    """Applications on the tones of pictures drawn from the embeddings; screens and texts at a tenth of their size."""
    row = "flatten(transform(slice(embedding, j * 8 + 1, 8), v -> array_repeat(cast(floor((cast(v as double) + 1) * 2) as int) * 60, 24)))"
    grey = f"transform(array(transform(sequence(0, 7), j -> {row})), k -> flatten(transform(sequence(0, 107), y -> k[y div 14])))[0]"
    m = S.matches(spark, d).selectExpr("movie_url", "frameset", "uid", "text", "x div 10 x", "y div 10 y", "w div 4 w", "h div 4 h")
    i = S.table(spark, d, "embeddings").selectExpr("concat('m', vec_id % 10) movie_url", "vec_id frameset", f"{grey} grey", "192 width", "108 height")
    return applications.movie_apps(m, i, None, applications.Rules(aside=1, tabs_end=8, most_area=9000, least_overlap=4, row_gap=2, header_height=12, header_gap=2, header_wider=30, least_width=12, least_height=4))


def _images(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.expr("transform(embedding, v -> cast(floor((cast(v as double) + 1) * 127) as int) % 256)").alias("grey"), F.lit(8).alias("width"), F.lit(8).alias("height"))


@plain
def red1_masked(spark, d):
    """Small images with two regions blurred."""
    i = _images(spark, d)
    regions = i.select("image", F.expr("inline(array(struct(1 ord, 1 x, 1 y, 3 w, 2 h), struct(2 ord, 4 x, 4 y, 9 w, 9 h)))"))
    return images.masked(i, regions, "blur_7x7")


@query("select vec_id image, list_transform(range(0, 64), lambda i: case when i % 8 between 2 and 5 and i // 8 between 1 and 3 then 0 else floor((embedding[i + 1]::double + 1) * 127)::int % 256 end)::varchar grey from embeddings")
def red1_black(spark, d):
    i = _images(spark, d)
    out = images.masked(i, i.selectExpr("image", "1 ord", "2 x", "1 y", "3 w", "2 h"), "black_rectangle")
    return out.select("image", F.concat(F.lit("["), F.array_join(F.col("grey").cast("array<string>"), ", "), F.lit("]")).alias("grey"))


@plain
def t4_mesh(spark, d):
    """Small images where the area matched in the last one is found again."""
    i = _images(spark, d).selectExpr("concat('m', image % 20) movie_url", "cast(image div 20 as long) place", "transform(grey, v -> case when v > 128 then 255 else 0 end) grey", "width", "height")
    found = i.where("place % 3 = 0").selectExpr("movie_url", "place", "1 uid", "0 x", "0 y", "6 w", "6 h")
    return images.mesh_matches(i, found, 2, 0, 0.9)


@plain
def t5g_colour_regions(spark, d):
    """Boxes of the bright spots in a part of small images."""
    i = _images(spark, d)
    return images.colour_regions(i, i.selectExpr("image", "1 x1", "0 y1", "8 x2", "6 y2"), 150, 255, least=2)


def _template_frames(spark, d):
    """Small images as frames of movies, in order."""
    return _images(spark, d).selectExpr("concat('m', image % 10) movie_url", "image frameset", "image place", "grey", "width", "height")


def _templates(spark, d):
    """Cuttings of the first images: 4 x 3 pixels from (2, 3) and 5 x 5 from (0, 1)."""
    cut = "transform(sequence(0, {w} * {h} - 1), i -> grey[({y} + i div {w}) * 8 + {x} + i % {w}]) grey"
    one = lambda where, name, **k: _images(spark, d).where(where).selectExpr(f"concat('{name}', image) anchor_id", cut.format(**k), f"{k['w']} width", f"{k['h']} height")
    both = one("image < 3", "a", x=2, y=3, w=4, h=3).unionByName(one("image in (3, 4)", "b", x=0, y=1, w=5, h=5))
    return both.selectExpr("*", "cast(null as string) scale", "'0.7' percent", "anchor_id = 'a1' multiple")


@plain
def t1_template(spark, d):
    """Cuttings of some small images found in all of them."""
    return templates.template_matches(_template_frames(spark, d), _templates(spark, d))


@plain
def t1c_adaptive(spark, d):
    """The same movie by movie, with the scales that a movie has settled on."""
    return templates.template_matches(_template_frames(spark, d), _templates(spark, d), adaptive=True)


def _spread(df):
    """Rows over all cores: what is drawn from a small file's rows is large."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _tiles(spark, d):
    """Small images four times as large, with a dark line across: 32 x 32."""
    return _spread(_images(spark, d)).selectExpr("image", "transform(sequence(0, 1023), i -> case when i div 32 = 20 and i % 32 between 2 and 29 then 0 else grey[(i div 128) * 8 + (i % 32) div 4] end) grey", "32 width", "32 height")


@plain
def red2_erased(spark, d):
    """Larger images with the text of two regions erased by closing, lines kept."""
    i = _tiles(spark, d)
    regions = i.select("image", F.expr("inline(array(struct(1 ord, 0 x, 8 y, 32 w, 24 h), struct(2 ord, 4 x, 0 y, 12 w, 12 h)))"))
    return erase.erased(i, regions, reach=5)


@plain
def red2_partitioned(spark, d):
    """The same by colours."""
    i = _tiles(spark, d)
    return erase.erased(i, i.selectExpr("image", "1 ord", "0 x", "0 y", "32 w", "32 h"), "color_partitioned", least=40, reach=5)


@query("select vec_id image, list_transform(range(0, 64), lambda i: case when (i % 8 - 3) * (i % 8 - 3) * 16 + (i // 8 - 4) * (i // 8 - 4) * 9 <= 144 then floor((embedding[i + 1]::double + 1) * 127)::int % 256 else round_even((floor((embedding[i + 1]::double + 1) * 127)::int % 256) / 2.0, 0)::int end)::varchar grey from embeddings")
def red4_shaded(spark, d):
    """Small images darkened outside of an oval (radii 3 and 4), without a line."""
    i = _images(spark, d)
    out = erase.illustrated(i, i.selectExpr("image", "1 ord", "'oval' kind", "3 a", "4 b", "3 c", "4 d", "0 colour"), line=0, shade=True)
    return out.select("image", F.concat(F.lit("["), F.array_join(F.col("grey").cast("array<string>"), ", "), F.lit("]")).alias("grey"))


@plain
def red4_oval(spark, d):
    """An oval and a box drawn on larger images."""
    i = _tiles(spark, d)
    marks = i.select("image", F.expr("inline(array(struct(1 ord, 'oval' kind, 15 a, 14 b, 10 c, 7 d, 255 colour), struct(2 ord, 'box' kind, 3 a, 3 b, 28 c, 26 d, 0 colour)))"))
    return erase.illustrated(i, marks, line=2, shade=True)


def _desktops(spark, d):
    """Frames of 480 x 240 pixels, one a supplier: a line across, and one or two upright ones."""
    grey_bytes = lambda greys: f"X'{bytes(greys).hex()}'"
    base = lambda k: grey_bytes(40 + (x + k) % 3 for x in range(480))
    line = lambda k, at, grey: f"concat(substring({base(k)}, 1, {at}), {grey_bytes([grey] * 3)}, substring({base(k)}, {at} + 4, 480))"
    three = lambda at, grey: "array(" + ", ".join(line(k, at, grey) for k in range(3)) + ")"
    above, below = three("150 + cast(s_suppkey % 90 as int)", 250), three("280 + cast(s_suppkey % 70 as int)", 245)
    # the few kinds of rows are made once and put together: a whole row at a time, a byte a pixel
    rows = "concat(" + ", ".join("k.line" if 118 <= y <= 120 else f"k.above[{2 * y % 3}]" if y < 118 else f"k.below[{2 * y % 3}]" for y in range(240)) + ")"
    p = f"transform(array(struct({above} above, {below} below, {grey_bytes([255] * 480)} line)), k -> {rows})[0]"
    return _spread(S.table(spark, d, "supplier")).selectExpr("concat('m', s_suppkey % 10) movie_url", "s_suppkey frameset", f"{p} grey", "480 width", "240 height")


@plain
def t8_screens(spark, d):
    """The screens of made-up desktops."""
    return screens.screens(_desktops(spark, d))


@plain
def t8_single_screen(spark, d):
    """Rectangles on the screen of their desktop that holds most of them."""
    boxes = S.table(spark, d, "lineitem").selectExpr("concat('m', l_suppkey % 10) movie_url", "l_suppkey frameset", "l_orderkey * 10 + l_linenumber uid", "cast(l_partkey % 460 as int) x", "cast(l_orderkey % 230 as int) y", "12 w", "8 h")
    return focus.on_one_screen(boxes, stored(screens.screens(_desktops(spark, d)))).select("movie_url", "frameset", "uid")


@query("""with e as (select vec_id, list_transform(range(1, 65), lambda i: floor((embedding[i]::double + 1) * 127)::int % 256) g from embeddings)
select 'm' || (vec_id % 5) movie_url, (vec_id // 5)::int "second", g::varchar grey from e where vec_id // 5 between 10 and 39 and vec_id % 5 <> 2""")
def src2_range(spark, d):
    """Frames written as recordings in chunks of 20 seconds and read back by movie and range of seconds."""
    path = new_folder(spark, "recordings")
    frames = _images(spark, d).selectExpr("concat('m', image % 5) movie_url", "cast(image div 5 as int) second", "width", "height", "grey")
    recordings.write_recordings(frames, path, chunk=20)
    back = recordings.read_recordings(spark, path).where("second >= 10 and second < 40").where(F.col("movie_url").isin("m0", "m1", "m3", "m4"))
    return back.select("movie_url", "second", F.concat(F.lit("["), F.array_join(F.col("grey").cast("array<string>"), ", "), F.lit("]")).alias("grey"))


def _large(spark, d):
    """Small images eight times as large: 64 x 64."""
    return _spread(_images(spark, d)).selectExpr("concat('m', image % 10) movie_url", "image frameset", "transform(sequence(0, 4095), i -> grey[(i div 512) * 8 + (i % 64) div 8]) grey", "64 width", "64 height")


@plain
def t10_features(spark, d):
    """Corners of larger images with their descriptors."""
    return features.features(_large(spark, d), list(sets.FRAME))


@plain
def t10_boxes(spark, d):
    """The boxes around each image's corners."""
    return features.feature_boxes(features.features(_large(spark, d), list(sets.FRAME)), list(sets.FRAME))


@query("""with p as (select p_partkey id, p_partkey // 4 g, p_partkey % 4 k from part), w as (select id, xor(g * 2654435761, (1 << (k * 5))::bigint) d0, g * 40503 d1, xor(g * 69069 + 7, (k % 2)::bigint) d2, g * 9176263 + 1 d3 from p),
l as (select * from w where id % 2 = 0), r as (select * from w where id % 3 = 0)
select l.id, r.id r_id, (bit_count(xor(l.d0, r.d0)) + bit_count(xor(l.d1, r.d1)) + bit_count(xor(l.d2, r.d2)) + bit_count(xor(l.d3, r.d3)))::int distance from l, r
where bit_count(xor(l.d0, r.d0)) + bit_count(xor(l.d1, r.d1)) + bit_count(xor(l.d2, r.d2)) + bit_count(xor(l.d3, r.d3)) <= 12""")
def t10_near(spark, d):
    """Pairs of descriptors within 12 bits, of numbers made from the parts' keys."""
    p = S.table(spark, d, "part").selectExpr("p_partkey id", "p_partkey div 4 g", "p_partkey % 4 k")
    w = p.selectExpr("id", "g * 2654435761 ^ shiftleft(1L, cast(k * 5 as int)) d0", "g * 40503 d1", "(g * 69069 + 7) ^ (k % 2) d2", "g * 9176263 + 1 d3")
    return features.near_descriptors(w.where("id % 2 = 0"), w.where("id % 3 = 0"), 12).select("id", "r_id", "distance")


def _marked(spark, d):
    """Larger images with a cross drawn at a place that the image's number tells, and where it is."""
    px, py = "image % 7 * 6", "image % 5 * 9"
    cross = f"x between {px} and {px} + 15 and (abs(x - {px} - (y - {py})) < 2 or abs(x - {px} + y - {py} - 15) < 2)"
    # the eight kinds of rows are made once; only the rows that the cross crosses are made pixel by pixel
    lines = "transform(sequence(0, 7), k -> transform(sequence(0, 63), x -> grey[k * 8 + x div 8] div 4))"
    rows = f"flatten(transform(sequence(0, 63), y -> case when y between {py} and {py} + 15 then transform(k[y div 8], (v, x) -> case when {cross} then 240 else v end) else k[y div 8] end))"
    f = _spread(_images(spark, d)).selectExpr("concat('m', image % 10) movie_url", "image frameset", f"transform(array({lines}), k -> {rows})[0] grey", "64 width", "64 height")
    return f, _images(spark, d).selectExpr("concat('m', image % 10) movie_url", "image frameset", f"cast({px} as int) x", f"cast({py} as int) y", "16 w", "16 h")


@plain
def t9_detect(spark, d):
    """Crosses found in the images of odd number by what was learnt from those of even number; the best of overlapping boxes."""
    f, t = _marked(spark, d)
    f = stored(f)
    model = detector.train(f.where("frameset % 2 = 0"), t.where("frameset % 2 = 0"), detector.Spec(16, 16, 4, 2, 9, 3), distractions=4)
    found = detector.detect(f.where("frameset % 2 = 1"), model).withColumn("uid", F.xxhash64(*sets.FRAME, "x", "y", "scale"))
    return layout.suppressed(stored(found))  # which reads them twice


@plain
def t5_grown_grid(spark, d):
    """Areas of one job grown southwards over the grid of the other jobs' texts."""
    m = S.matches(spark, d)
    return grower.grow(m.where("job_id = 'job_0' and y < 300"), "capture_grid", "south", 1920, 1200, texts=m.where("job_id <> 'job_0'"), threshold=1, offsets={"west": 300, "east": 300})


@plain
def t5_grown_colours(spark, d):
    """Areas of small images grown over the brighter pixels beside them, in four directions."""
    i = _images(spark, d).selectExpr("concat('m', image % 10) movie_url", "image frameset", "grey", "width", "height")
    area = i.selectExpr("movie_url", "frameset", "frameset uid", "3 x", "3 y", "2 w", "2 h")
    out = [grower.grow(area, "color_projection", way, 8, 8, frames=i, ranges=[(120, 255)], build=build).withColumn("way", F.lit(f"{way} {build}")) for way in grower.DIRECTIONS for build in ("near_flood", "furthest_edge")]
    return reduce(DataFrame.unionByName, out)
