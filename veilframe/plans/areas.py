"""Queries over rectangles: masks and scores, selected areas, grown areas, gates, filters, joins by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import boxes, masks, regions, scores, sets
from veilframe.plans.registry import plain, query
from veilframe.sources import tables as S

M = S.MATCHES_SQL
PIXELS = "px as (select movie_url, frameset, job_id, uid, x0, y0 from (select *, unnest(range(y, y + h + 1)) y0 from m), lateral (select unnest(range(x, x + w + 1)) x0))"
SIDES = f"{M}, {PIXELS}, p as (select movie_url, frameset, x0, y0, bool_or(job_id = 'job_0') f, bool_or(job_id = 'job_1') s from px where job_id in ('job_0', 'job_1') group by all)"
COUNTS = f"{SIDES}, c as (select movie_url, frameset, count(*) filter (where s) t_pos, 2073600 - count(*) filter (where s) t_neg, count(*) filter (where f and not s) f_pos, count(*) filter (where s and not f) f_neg from p group by all)"


def _job(spark, d, n):
    return S.matches(spark, d).where(f"job_id = 'job_{n}'")


@query(f"with {COUNTS} select * from c")
def agg1_frame_counts(spark, d):
    return masks.frame_counts(_job(spark, d, 0), _job(spark, d, 1))


@query(f"with {SIDES} select movie_url, frameset, count(*) filter (where f <> s) f_all from p group by all")
def agg2_false_all(spark, d):
    return masks.frame_counts(_job(spark, d, 0), _job(spark, d, 1)).select(*sets.FRAME, (F.col("f_pos") + F.col("f_neg")).alias("f_all"))


@query(f"with {COUNTS} select movie_url, frameset, f_pos, f_neg, round_even(greatest(0.0::double, 100.0::double - 100.0::double * 1.0 * f_pos / 2073600 - 100.0::double * 20.0 * f_neg / 2073600), 2) score from c")
def agg4_mask_score(spark, d):
    counts = masks.frame_counts(_job(spark, d, 0), _job(spark, d, 1)).withColumn("total", F.lit(2073600))
    return scores.frame_scores(counts).select("movie_url", "frameset", "f_pos", "f_neg", "score")


MASK_SCORES = f"{COUNTS}, s as (select movie_url, frameset, round_even(greatest(0.0::double, 100.0::double - 100.0::double * 1.0 * f_pos / 2073600 - 100.0::double * 20.0 * f_neg / 2073600), 2) score from c), v as (select movie_url, round_even(avg(score::decimal(12,2)), 2) score, min(score) lowest, max(score) highest, count(*) filter (where score < 97) n_failed, count(*) n_frames from s group by all)"
STRICT = {"frame_passing_score": 97.0, "hard_fail_from_any_frame": True}


def _mask_movies(spark, d):
    counts = masks.frame_counts(_job(spark, d, 0), _job(spark, d, 1)).withColumn("total", F.lit(2073600))
    return scores.movie_scores(scores.frame_scores(counts, STRICT), STRICT)


@query(f"with {MASK_SCORES} select *, n_failed >= 1 or score < 70 failed from v")
def agg5_mask_movies(spark, d):
    """Movies scored by their masks; a single frame below 97 fails them."""
    return _mask_movies(spark, d)


@query(f"with {MASK_SCORES} select round_even(avg(score::decimal(12,2)), 2) score, min(score) lowest, max(score) highest, bool_or(n_failed >= 1 or score < 70) failed from v")
def agg6_mask_job(spark, d):
    """The job scored by its movies' masks."""
    return scores.job_score(_mask_movies(spark, d))


@plain
def agg4_missed(spark, d):
    """Framesets scored by masks that fail if an item of the standard is missed."""
    return scores.frame_scores(agg3_missed(spark, d).withColumn("total", F.lit(2073600)), {"max_num_missed_entities_single_frameset": 0})


@query(f"with {M}, {PIXELS} select movie_url, frameset, round_even(100.0::double * count(*) / 2073600, 4) \"percent\" from (select distinct movie_url, frameset, x0, y0 from px where job_id = 'job_0') group by all")
def agg9_share(spark, d):
    return masks.share_of_frame(_job(spark, d, 0))


@query(f"with {M}, {PIXELS} select movie_url, frameset, count(*) filter (where last <> 'job_2') area from (select movie_url, frameset, x0, y0, arg_max(job_id, row(uid, job_id)) last from px where y0 < 1080 group by all) group by all")
def win7_painters(spark, d):
    m = S.matches(spark, d).withColumn("polarity", F.expr("case when job_id = 'job_2' then 'negative' else 'positive' end"))
    return masks.painted_area(m, ["uid", "job_id"])


@plain
def set4_components(spark, d):
    """Boxes around what all three jobs cover together, frameset by frameset."""
    wide = S.matches(spark, d).withColumn("w", F.expr("w * 12")).withColumn("h", F.expr("h * 15"))
    return masks.intersected(wide, ["job_0", "job_1", "job_2"])


def _marks(spark, d):
    """Found rectangles of job_0 and job_2; what people marked in every third frameset."""
    m = S.matches(spark, d).select(*sets.FRAME, "job_id", F.col("uid").alias("ord"), "x", "y", "w", "h")
    rows = m.select("*", F.expr("case when job_id <> 'job_1' then 'found' when frameset % 3 = 0 then 'desired' else 'unwanted' end").alias("kind"), F.expr("case when job_id = 'job_2' then 'negative' else 'positive' end").alias("polarity"))
    verdicts = m.where("frameset % 7 = 0").select(*sets.FRAME, F.expr("case when frameset % 2 = 0 then 'pass' else 'fail' end").alias("kind")).distinct()
    return rows.drop("job_id").unionByName(verdicts, allowMissingColumns=True)


@plain
def agg3_missed(spark, d):
    """Pixels and missed items of each frameset, against job_1 as the standard."""
    m = S.matches(spark, d).where("job_id <> 'job_2'")
    return masks.score_counts(m.select(*sets.FRAME, F.expr("case when job_id = 'job_0' then 'found' else 'expected' end").alias("kind"), F.col("uid").alias("ord"), F.lit("positive").alias("polarity"), "x", "y", "w", "h"))


@plain
def agg8_manual(spark, d):
    """Pixels and missed items of each frameset, as people's marks would have it."""
    return masks.score_counts(_marks(spark, d))


@query(f"with {M}, {PIXELS} select movie_url, frameset, count(*) t_pos, 0::bigint f_pos, 0::bigint f_neg from (select distinct movie_url, frameset, x0, y0 from px where job_id = 'job_0' and y0 < 1080) group by all")
def agg7_autopass(spark, d):
    found = _job(spark, d, 0).select(*sets.FRAME, F.lit("found").alias("kind"), F.col("uid").alias("ord"), F.lit("positive").alias("polarity"), "x", "y", "w", "h")
    return masks.score_counts(found).select(*sets.FRAME, "t_pos", "f_pos", "f_neg")


APPS = f"{M}, g as (select * replace (nullif(app_id, 'Brand#5') as app_id) from m)"


def _gaps(spark, d):
    return S.matches(spark, d).withColumn("app_id", F.expr("nullif(app_id, 'Brand#5')"))


@query(f"with {APPS}, k as (select movie_url, frameset from g group by all having not (bool_and(app_id is not null) and not bool_or(coalesce(app_id = 'Brand#3', false)))) select uid, frameset from g join k using (movie_url, frameset)")
def t1d_app_gate(spark, d):
    return regions.app_gate(_gaps(spark, d), "Brand#3").select("uid", "frameset")


SCALED = f"{M}, t as (select *, case when l = 0 then 'a1' when l = 1 then 'b2-1' else 'zz' end anchor_id, case when uid % 2 = 0 then 0.8::double else 1.25::double end scale from (select *, uid % 3 l from m))"


@query(f"""with {SCALED}, a as (select 'a1' anchor, 100 ax, 60 ay union all select 'b2', 10, 20), z as (select 'a1' anchor, 200 x1, 100 y1, 400 x2, 140 y2 union all select 'b2', 50, 60, 90, 80)
select movie_url, frameset, uid, trunc(x + (x1 - ax) / scale)::int x, trunc(y + (y1 - ay) / scale)::int y, trunc((x2 - x1) / scale)::int w, trunc((y2 - y1) / scale)::int h from t join a on contains(anchor_id, anchor) join z using (anchor)""")
def t1f_tier2(spark, d):
    m = S.matches(spark, d).withColumn("anchor_id", F.expr("case uid % 3 when 0 then 'a1' when 1 then 'b2-1' else 'zz' end")).withColumn("scale", F.expr("case when uid % 2 = 0 then 0.8D else 1.25D end"))
    anchors = spark.createDataFrame([("a1", 100, 60), ("b2", 10, 20)], "anchor string, ax int, ay int")
    zones = spark.createDataFrame([(1, None, 50, 60, 90, 80), (2, "a1", 0, 0, 9, 9), (3, "a1", 200, 100, 400, 140)], "ord int, zone_anchor string, x1 int, y1 int, x2 int, y2 int")
    return regions.tier_2(m, anchors, zones)


@query(f"""with {M}, f as (select distinct movie_url, frameset from m), o as (select * from m where (app_id = 'Brand#1' or app_id is null) qualify row_number() over (partition by movie_url, frameset order by uid) = 1)
select f.movie_url, f.frameset, case when scanner_type = 'R' then x else 100 + coalesce(x - 50, 0) end::int x1, case when scanner_type = 'R' then y else 200 + coalesce(y - 60, 0) end::int y1, case when scanner_type = 'R' then x + w else 300 + coalesce(x - 50, 0) end::int x2, case when scanner_type = 'R' then y + h else 400 + coalesce(y - 60, 0) end::int y2 from f left join o using (movie_url, frameset)""")
def t2g_window(spark, d):
    m = S.matches(spark, d)
    typed = m.withColumn("scanner_type", F.expr("case when scanner_type = 'R' then 'selected_area' else 'ocr' end"))
    return regions.shifted_window(m, typed, (100, 200), (300, 400), (50, 60), "Brand#1")


@query(f"with {M} select * from (select movie_url, frameset, max(x) x1, max(y) y1, min(x + w) x2, min(y + h) y2 from m group by all) where x1 <= x2 and y1 <= y2")
def t2h_limits(spark, d):
    return regions.common_area(S.matches(spark, d))


@query("with t as (select p_partkey uid, p_name \"text\" from part) select uid, \"text\" from t where regexp_matches(\"text\", '^[a-m]') and uid % 2 = 0")
def t2e_refilter(spark, d):
    earlier = S.table(spark, d, "part").selectExpr("p_partkey uid", "p_name text", "concat('job_', p_partkey % 2) job_id")
    return S.result_of(earlier, "job_0").where(F.col("text").rlike("^[a-m]")).select("uid", "text")


@query(f"with {M}, z as (select * from (values (1, 10, 10, 50, 60), (2, 100, 0, 40, 40)) v(zone, zx, zy, zw, zh)) select movie_url, frameset, zone, zx x, zy y, zw w, zh h from (select distinct movie_url, frameset from m), z")
def t3c_manual(spark, d):
    zones = spark.createDataFrame([(1, 10, 10, 50, 60), (2, 100, 0, 40, 40)], "zone int, x int, y int, w int, h int")
    return regions.manual_areas(S.matches(spark, d), zones)


@query(f"with {M} select distinct movie_url, frameset, 0 x, 0 y, case when movie_url = 'm1' then 9999 else 1920 end w, case when movie_url = 'm1' then 9999 else 1080 end h from m")
def t3d_full_screen(spark, d):
    f = S.matches(spark, d).select(*sets.FRAME).distinct().withColumn("width", F.expr("case when movie_url <> 'm1' then 1920 end")).withColumn("height", F.expr("case when movie_url <> 'm1' then 1080 end"))
    return regions.full_screens(f)


@query(f"""with {M}, c as (select *, count(*) over (partition by movie_url, frameset) n from m), one as (select * from c where n = 1)
select movie_url, frameset, uid, null::int side, x x1, y y1, x + w x2, y + h y2 from c where n > 1 union all select movie_url, frameset, uid, 0, 0, 0, 1920, y from one union all select movie_url, frameset, uid, 1, 0, y, x, y + h from one
union all select movie_url, frameset, uid, 2, x + w, y, 1920, y + h from one union all select movie_url, frameset, uid, 3, 0, y + h, 1920, 1080 from one""")
def t3f_exterior(spark, d):
    return regions.to_exterior(S.matches(spark, d), 1920, 1080)


@query(f"""with {M}, z as (select * from (values (1, 200, 100, 900, 500), (2, 800, 400, 1500, 900)) v(zone, x1, y1, x2, y2))
select movie_url, frameset, uid, zone, greatest(x, x1) x, greatest(y, y1) y, least(x + w, x2) - greatest(x, x1) w, least(y + h, y2) - greatest(y, y1) h from m join z on x < x2 and x + w > x1 and y < y2 and y + h > y1""")
def t3h_max_zones(spark, d):
    zones = spark.createDataFrame([(1, 200, 100, 900, 500), (2, 800, 400, 1500, 900)], "zone int, x1 int, y1 int, x2 int, y2 int")
    return regions.clip_to_zones(S.matches(spark, d), zones)


@query(f"""with {SCALED} select movie_url, frameset, uid, (floor(50 + (120 - 50) / scale) + x - 50)::int x, (floor(60 + (90 - 60) / scale) + y - 60)::int y,
round(100 / product(scale) over (partition by movie_url, frameset order by uid rows between unbounded preceding and current row), 4) w, round(40 / product(scale) over (partition by movie_url, frameset order by uid rows between unbounded preceding and current row), 4) h from t""")
def t3i_min_zones(spark, d):
    m = S.matches(spark, d).withColumn("scale", F.expr("case when uid % 2 = 0 then 0.8D else 1.25D end"))
    return regions.minimum_zones(m, (120, 90, 220, 130), (50, 60))


@query(f"with {SCALED} select uid, (floor(50 + (300 - 50) / scale) + x - 50)::int px, (floor(60 + (10 - 60) / scale) + y - 60)::int py from t")
def t3j_seed(spark, d):
    m = S.matches(spark, d).withColumn("scale", F.expr("case when uid % 2 = 0 then 0.8D else 1.25D end"))
    x, y = regions.scaled_point(300, 10, (50, 60))
    return m.select("uid", x.alias("px"), y.alias("py"))


FIRST = f"{M}, o as (select * from m qualify row_number() over (partition by movie_url, frameset order by uid) = 1)"


@query(f"""with {FIRST} select movie_url, frameset, uid, 'north' side, x x1, 0 y1, x + w x2, y y2 from o where y > 0 union all select movie_url, frameset, uid, 'south', 0, y + h, 1920, 1080 from o where y + h <> 1080
union all select movie_url, frameset, uid, 'east', x + w, y, 1920, y + h from o where x + w <> 1920 union all select movie_url, frameset, uid, 'west', 0, 0, x, 1080 from o where x <> 0""")
def t3k_directions(spark, d):
    m = S.matches(spark, d)
    one = lambda side, wide: regions.everything(m, side, 1920, 1080, as_wide=wide).withColumn("side", F.lit(side))
    return one("north", True).unionByName(one("south", False)).unionByName(one("east", True)).unionByName(one("west", False))


ROI = f"{M}, r as (select movie_url, frameset, uid area, x - 40 x1, y + h y1, x + w + 60 x2, 1080 y2 from m where job_id = 'job_0')"


@query(f"with {ROI} select * from r")
def t5a_roi(spark, d):
    return regions.growth_roi(_job(spark, d, 0), "south", 1920, 1080, {"west": 40, "east": 60})


@query(f"with {ROI} select r.area, m.uid from m join r using (movie_url, frameset) where x between x1 and x2 and y between y1 and y2 and x + w between x1 and x2 and y + h between y1 and y2")
def t5b_inside(spark, d):
    rois = regions.growth_roi(_job(spark, d, 0), "south", 1920, 1080, {"west": 40, "east": 60})
    return regions.inside_roi(S.matches(spark, d), rois).select("area", "uid")


@query(f"""with {ROI}, t as (select r.*, m.uid template, m.y + m.h bottom from r join m using (movie_url, frameset) where m.job_id = 'job_1' and m.x <= x2 and m.y <= y2 and m.x + m.w >= x1 and m.y + m.h >= y1 qualify row_number() over (partition by movie_url, frameset, area order by m.uid) = 1)
select t.movie_url, t.frameset, area, template, m.x, m.y + m.h y, m.w, bottom - m.y - m.h h from t join m on m.uid = t.area and m.movie_url = t.movie_url and m.frameset = t.frameset and m.job_id = 'job_0'""")
def t5h_captured(spark, d):
    return regions.captured(_job(spark, d, 0), _job(spark, d, 1), "south", 1920, 1080, {"west": 40, "east": 60})


@query(f"with {M} select uid, frameset from m a where job_id = 'job_0' and exists (select 1 from m r where r.job_id = 'job_1' and r.movie_url = a.movie_url and r.frameset = a.frameset and a.x between r.x - 300 and r.x - 300 + r.w + 600 and a.y between r.y - 300 and r.y - 300 + r.h + 600)")
def t6g_bounds(spark, d):
    grown = _job(spark, d, 1).selectExpr("movie_url", "frameset", "x - 300 x", "y - 300 y", "w + 600 w", "h + 600 h")
    return regions.within_regions(_job(spark, d, 0), grown).select("uid", "frameset")


@query(f"with {M} select uid, frameset from m a where job_id = 'job_0' and exists (select 1 from m r where r.job_id = 'job_1' and r.movie_url = a.movie_url and r.frameset = a.frameset and a.x <= r.x + r.w * 5 and r.x <= a.x + a.w and a.y <= r.y + r.h * 9 and r.y <= a.y + a.h)")
def jn6_overlap(spark, d):
    return regions.overlapping(_job(spark, d, 0), _job(spark, d, 1).withColumn("w", F.expr("w * 5")).withColumn("h", F.expr("h * 9"))).select("uid", "frameset")


@query(f"with {M} select uid from m where scanner_type in ('A', 'N') and (\"text\" similar to '.*(red|blue).*' or regexp_matches(\"text\", '^s'))")
def flt2_lists(spark, d):
    m = S.matches(spark, d)
    return m.where(regions.any_of("scanner_type", "in_list", ["A", "N"])).where(regions.any_of("text", "matches_regex_list", ["red|blue", "^s"])).select("uid")


@query(f"with {M} select uid from m where (movie_url, frameset) in (select movie_url, frameset from m where scanner_type = 'A')")
def flt4_type_exists(spark, d):
    return regions.with_scanner_type(S.matches(spark, d), "A").select("uid")


@query(f"with {M} select uid, x, y, w, h, case when uid % 2 = 0 then 'location' else 'start' end geom_src from m")
def prj3_normalise(spark, d):
    m = S.matches(spark, d).selectExpr("uid", "case when uid % 2 = 0 then array(x, y) end location", "case when uid % 2 = 0 then array(w, h) end size", "case when uid % 3 > 0 or uid % 2 = 1 then array(x, y) end start", "case when uid % 3 > 0 or uid % 2 = 1 then array(x + w, y + h) end `end`")
    return regions.normalised(m).select("uid", "x", "y", "w", "h", "geom_src")


@query(f"with {M}, s as (select distinct movie_url, frameset, 'img_' || frameset || '.png' image from m) select uid, image from m join s using (movie_url, frameset)")
def jn1_source_image(spark, d):
    m = S.matches(spark, d)
    images = m.select(*sets.FRAME, F.expr("concat('img_', frameset, '.png')").alias("image")).distinct()
    return m.join(images, list(sets.FRAME)).select("uid", "image")


@query(f"with {S.FRAMES_SQL} select event_id, movie_url, frameset from f")
def jn2_frame_membership(spark, d):
    f = S.frames(spark, d)
    sets_of = f.groupBy("movie_url", "frameset").agg(F.collect_list("image").alias("images")).select("movie_url", "frameset", F.explode("images").alias("image"))
    return f.select("event_id", "movie_url", "image").join(sets_of, ["movie_url", "image"]).select("event_id", "movie_url", "frameset")


@query("with s as (select p_partkey id, ['+/-10/1', '+/-20/5', '1:1'][1 + p_partkey % 3] scale from part), n as (select '+/-10/1' scale, 10 k, 11 n union all select '+/-20/5', 20, 9) select id, scale, 0::int rung, 1.0::double factor from s where scale = '1:1' union all select id, scale, i::int, round(1 - k / 100.0::double + (n.n - 1 - i) * (2 * k / 100.0::double / (n.n - 1)), 6) from s join n using (scale), lateral (select unnest(range(n.n)) i)")
def t1a_ladder(spark, d):
    t = S.table(spark, d, "part").selectExpr("p_partkey id", "element_at(array('+/-10/1', '+/-20/5', '1:1'), cast(1 + p_partkey % 3 as int)) scale")
    return regions.scale_ladder(t)


@query("select p_partkey id, case p_partkey % 5 when 0 then 0.9 when 1 then 0.75 when 2 then 0.9 when 3 then 1.0 else 0.9 end::double threshold from part")
def t1b_threshold(spark, d):
    t = S.table(spark, d, "part").selectExpr("p_partkey id", "element_at(array('0.8', '75', 'high', '1', null), cast(1 + p_partkey % 5 as int)) percent")
    return t.select("id", regions.match_threshold("percent").alias("threshold"))


@query(f"with {M} select movie_url, frameset, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from m where job_id = 'job_0' group by all")
def t3_selected_areas(spark, d):
    return boxes.bounding_box(_job(spark, d, 0))


@query(f"with {M} select movie_url, frameset, uid, row_number() over (partition by movie_url, frameset order by y, x, uid) place from m")
def ord2_reading_order(spark, d):
    return boxes.reading_order(S.matches(spark, d)).select("movie_url", "frameset", "uid", "place")


@query(f"with {M} select movie_url, frameset, arg_max(uid, row(w * h, -uid)) uid from m group by all")
def lim4_largest(spark, d):
    return boxes.largest(S.matches(spark, d), "w * h").select("movie_url", "frameset", "uid")


@query(f"""with {M}, b as (select movie_url, frameset, min(x) x, min(y) y, max(x + w) x2, max(y + h) y2 from m group by all), e as (select movie_url, frameset, 0 x1, 0 y1, 1920 x2, y y2 from b union all select movie_url, frameset, 0, y, x, y2 from b union all select movie_url, frameset, x2, y, 1920, y2 from b union all select movie_url, frameset, 0, y2, 1920, 1080 from b)
select movie_url, frameset, greatest(x1, 100)::double x, greatest(y1, 50)::double y, (least(x2, 1500) - greatest(x1, 100))::double w, (least(y2, 900) - greatest(y1, 50))::double h from e where x1 < 1500 and x2 > 100 and y1 < 900 and y2 > 50""")
def t3_all_rules(spark, d):
    zones = spark.createDataFrame([(1, 100, 50, 1500, 900)], "zone int, x1 int, y1 int, x2 int, y2 int")
    return regions.selected_areas(S.matches(spark, d), 1920, 1080, merge=True, exterior_of=True, zones=zones)
