"""The operators as registered queries, each beside the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import boxes, frames, jobs, scores, sets, texts
from veilframe.plans import areas, catalog, layouts  # noqa: F401  they register their queries
from veilframe.plans.registry import ORACLES, PLAIN, QUERIES, query  # noqa: F401
from veilframe.sources import tables as S

M, FR, J = S.MATCHES_SQL, S.FRAMES_SQL, S.JOBS_SQL
RANK = "row_number() over (partition by movie_url, frameset, match_id order by job_id, uid)"


@query(f"with {M} select job_id, movie_url, frameset, uid, case when {RANK} = 1 then match_id::varchar else 'sum_key_' || uid end match_key from m")
def set1_sum(spark, d):
    return sets.bag_sum(S.matches(spark, d)).select("job_id", "movie_url", "frameset", "uid", "match_key")


@query(f"""with {M}, k as (select movie_url, frameset from m where job_id in ('job_0', 'job_1') group by all having count(distinct job_id) = 2)
select job_id, movie_url, frameset, uid from m where job_id in ('job_0', 'job_1') or (movie_url, frameset) in (select movie_url, frameset from k)""")
def set2_mandatory(spark, d):
    return sets.mandatory(S.matches(spark, d), ["job_0", "job_1"]).select("job_id", "movie_url", "frameset", "uid")


DIFF = f"""with {M} select movie_url, frameset, match_id, uid from m where job_id <> 'job_2'
and not exists (select 1 from m s where s.job_id = 'job_2' and s.movie_url = m.movie_url and s.frameset = m.frameset and s.match_id = m.match_id)"""


@query(DIFF)
def set3_diff(spark, d):
    m = S.matches(spark, d)
    return sets.difference(m.where("job_id <> 'job_2'"), m.where("job_id = 'job_2'")).select("movie_url", "frameset", "match_id", "uid")


@query(f"with {M} select movie_url, frameset, uid from m where job_id = 'job_0' and (movie_url, frameset) not in (select movie_url, frameset from m where job_id = 'job_1')")
def set3_diff_framesets(spark, d):
    m = S.matches(spark, d)
    return sets.difference(m.where("job_id = 'job_0'"), m.where("job_id = 'job_1'"), by_match=False).select("movie_url", "frameset", "uid")


@query(f"""with {M} select a.movie_url, a.frameset, a.uid, b.uid other, greatest(a.x, b.x) x, greatest(a.y, b.y) y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) h
from m a join m b on a.movie_url = b.movie_url and a.frameset = b.frameset and a.job_id = 'job_0' and b.job_id = 'job_1' and a.x <= b.x + b.w and b.x <= a.x + a.w and a.y <= b.y + b.h and b.y <= a.y + a.h""")
def set4_intersect(spark, d):
    m = S.matches(spark, d)
    return sets.intersect(m.where("job_id = 'job_0'"), m.where("job_id = 'job_1'"))


@query(f"with {M} select movie_url, frameset, uid, scanner_type, app_id from m where scanner_type = 'R' or app_id in ('Brand#1', 'Brand#12', 'Brand#3')")
def flt1_any_equals(spark, d):
    return sets.any_criterion(S.matches(spark, d), {"scanner_type": ["R"], "app_id": ["Brand#1", "Brand#12", "Brand#3"]}).select("movie_url", "frameset", "uid", "scanner_type", "app_id")


@query(f"with {M} select uid, frameset, x, y, x + w x2, y + h y2 from m where app_id is null or app_id = 'Brand#3'")
def flt3_app_corners(spark, d):
    return sets.of_app(S.matches(spark, d), "Brand#3").selectExpr("uid", "frameset", "x", "y", "x + w x2", "y + h y2")


@query(f"with {M} select movie_url, frameset, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h from m group by all")
def t3g_bbox(spark, d):
    return boxes.bounding_box(S.matches(spark, d))


@query(f"""with {M} select movie_url, frameset, uid, 0 side, 0 x1, 0 y1, 1920 x2, y y2 from m union all select movie_url, frameset, uid, 1, 0, y, x, y + h from m
union all select movie_url, frameset, uid, 2, x + w, y, 1920, y + h from m union all select movie_url, frameset, uid, 3, 0, y + h, 1920, 1080 from m""")
def t3e_invert(spark, d):
    return boxes.exterior(S.matches(spark, d), 1920, 1080)


@query(f"with {M} select movie_url, frameset, uid, x + w x, 0 y, 1920 - x - w w, 1080 h from m where 1920 - x - w > 0")
def t3k_everything(spark, d):
    return boxes.half_plane(S.matches(spark, d), "east", 1920, 1080)


@query(f"with {M} select movie_url, frameset, uid, greatest(x, 200) x, greatest(y, 100) y, least(x + w, 1200) - greatest(x, 200) w, least(y + h, 700) - greatest(y, 100) h from m where x < 1200 and x + w > 200 and y < 700 and y + h > 100")
def t3h_clip(spark, d):
    return boxes.clip(S.matches(spark, d), 200, 100, 1200, 700)


@query(f"with {M} select movie_url, frameset, uid from m a where exists (select 1 from m b where a.movie_url = b.movie_url and a.frameset = b.frameset and a.uid <> b.uid and (abs(a.y - b.y) <= 20 or abs(a.x - b.x) <= 20 or abs(a.x + a.w - b.x - b.w) <= 20))")
def t5c_aligned(spark, d):
    return boxes.aligned(S.matches(spark, d), 20).select("movie_url", "frameset", "uid")


@query(f"with {M} select movie_url, edge // 50 bin, count(*) n from (select movie_url, x edge from m union all select movie_url, x + w from m) group by all having count(*) >= 20")
def t5d_histogram(spark, d):
    return boxes.position_histogram(S.matches(spark, d), 50, 20)


@query(f"with {M} select movie_url, frameset, uid, trunc(x + 100 / 0.8)::int x, trunc(y + 40 / 0.8)::int y, trunc(200 / 0.8)::int w, trunc(40 / 0.8)::int h from m where scanner_type = 'A'")
def t1f_mask_zones(spark, d):
    return boxes.project_zone(S.matches(spark, d).where("scanner_type = 'A'"), (100, 60), (200, 100, 400, 140), "0.8D")


@query(f"""with {M} select movie_url, frameset, uid from m a where job_id = 'job_0' and exists (select 1 from m r where r.job_id = 'job_2' and r.movie_url = a.movie_url and r.frameset = a.frameset
and 2 * a.x + a.w between 2 * r.x - 600 and 2 * (r.x + r.w) + 600 and 2 * a.y + a.h between 2 * r.y - 400 and 2 * (r.y + r.h) + 400)""")
def jn6_within(spark, d):
    m = S.matches(spark, d)
    regions = m.where("job_id = 'job_2'").selectExpr("movie_url", "frameset", "x - 300 x", "y - 200 y", "w + 600 w", "h + 400 h")
    return boxes.within(m.where("job_id = 'job_0'"), regions).select("movie_url", "frameset", "uid")


@query(f"""with {M}, px as (select movie_url, frameset, y0, x0 from (select movie_url, frameset, x, w, unnest(range(y, y + h + 1)) y0 from m), lateral (select unnest(range(x, x + w + 1)) x0))
select movie_url, frameset, count(*) area from (select distinct movie_url, frameset, x0, y0 from px) group by all""")
def agg9_union_area(spark, d):
    return boxes.union_area(S.matches(spark, d))


@query(f"with {M} select m.uid, m.frameset, p.uid other_uid, p.app_id other_app from m left join (select distinct on (movie_url, frameset) movie_url, frameset, uid, app_id from m where job_id = 'job_1' order by movie_url, frameset, uid) p using (movie_url, frameset) where m.job_id = 'job_0'")
def jn3_left_ocr(spark, d):
    m = S.matches(spark, d)
    return sets.with_first(m.where("job_id = 'job_0'"), m.where("job_id = 'job_1'"), "uid", ["uid", "app_id"]).select("uid", "frameset", F.col("p.uid").alias("other_uid"), F.col("p.app_id").alias("other_app"))


@query(f"with {FR} select movie_url, frameset, count(*) n_frames, min(ts) first_ts, arg_min(image, row(ts, event_id)) image from f group by all")
def hsh2_group(spark, d):
    return frames.framesets(S.frames(spark, d))


ORDER = "o as (select *, row_number() over (partition by movie_url order by first_ts, frameset) place from (select movie_url, frameset, count(*) n_frames, min(ts) first_ts from f group by all))"


@query(f"with {FR}, {ORDER} select movie_url, frameset, place from o")
def ord1_frameset_order(spark, d):
    return frames.frameset_order(S.frames(spark, d)).select("movie_url", "frameset", "place")


@query(f"with {FR}, {ORDER} select o.movie_url, o.frameset, place from o left join (select movie_url, place stop from o where frameset = 'click') s using (movie_url) where stop is null or place < stop")
def hsh7_truncate(spark, d):
    return frames.truncate_at(S.frames(spark, d), "click").select("movie_url", "frameset", "place")


OVER = "over (partition by movie_url order by ts, event_id)"


@query(f"with {FR} select event_id, last_value(case when value > 50 then image end ignore nulls) over (partition by movie_url order by ts, event_id rows between unbounded preceding and current row) last_found from f")
def win2_ffill(spark, d):
    return frames.carried(S.frames(spark, d), "value > 50").select("event_id", "last_found")


@query(f"with {FR} select event_id, frameset, before from (select *, lag(frameset) {OVER} before from f) where before is null or before <> frameset")
def win1_lag(spark, d):
    return frames.changes(S.frames(spark, d)).select("event_id", "frameset", "before")


@query(f"with {FR} select event_id, (row_number() {OVER} - 1) // 50 batch from f")
def win6_batch(spark, d):
    return frames.batches(S.frames(spark, d), 50).select("event_id", "batch")


@query(f"with {FR} select event_id, case when s between 3 and 10 or s between 8 and 20 or s between 100 and 120 then image else 'black.png' end image from (select *, row_number() {OVER} - 1 s from f)")
def src16_blackout(spark, d):
    ranges = spark.createDataFrame([(3, 10), (8, 20), (100, 120)], "lo long, hi long")
    return frames.black_out(S.frames(spark, d), ranges, "black.png").select("event_id", "image")


@query(f"""with {FR}, r as (select movie_url, frameset, 'red_' || arg_min(image, event_id) redacted_image from f where value > 60 group by all), i as (select movie_url, frameset, 'ill_' || arg_min(image, event_id) illustrated_image from f where value > 99 group by all)
select event_id, coalesce(illustrated_image, redacted_image, image) final from f left join r using (movie_url, frameset) left join i using (movie_url, frameset)""")
def snk3_final_image(spark, d):
    f = S.frames(spark, d)
    pick = lambda least, head: f.where(f"value > {least}").groupBy("movie_url", "frameset").agg(F.concat(F.lit(head + "_"), F.min_by("image", "event_id")).alias({"red": "redacted_image", "ill": "illustrated_image"}[head]))
    return frames.final_image(f, pick(60, "red"), pick(99, "ill")).select("event_id", "final")


@query("select vec_id, cast(cast(coalesce(list_sum(list_transform(list_filter(range(1, 65), lambda i: i % 8 <> 0 and embedding[i + 1] > embedding[i]), lambda i: (1::bigint << cast(((i - 1) // 8) * 7 + (i - 1) % 8 as int)))), 0) as bigint) as varchar) frame_hash from embeddings")
def hsh1_dhash(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", T.difference_hash("embedding").alias("frame_hash"))


LCS = """(list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda old, i: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda nw, j: list_append(nw,
  case when substr(a, i[1], 1) = substr(b, j[1], 1) then old[j[1]] + 1 else greatest(old[j[1] + 1], nw[j[1]]) end), [0::bigint]), list_transform(range(0, length(b) + 1), lambda z: 0::bigint)))[-1]"""


@query(f"select p_partkey, a, b, cast(round_even(100 * (2.0::double * {LCS} / (length(a) + length(b))), 0) as int) ratio from (select p_partkey, p_name a, p_type b from part)")
def fuzz_ratio(spark, d):
    p = S.table(spark, d, "part").selectExpr("p_partkey", "p_name a", "p_type b")
    return p.withColumn("ratio", T.indel_ratio("a", "b"))


@query(f"""with t as (select distinct p_name a from part), p as (select row_number() over (order by b) ord, b from (select distinct p_name b from part)),
r as (select a, ord, b, cast(round_even(100 * (2.0::double * {LCS} / (length(a) + length(b))), 0) as int) ratio from t, p)
select a "text", arg_min(b, ord) phrase, arg_min(ratio, ord) ratio from r where ratio > 70 group by a""")
def t2a_fuzzy_phrases(spark, d):
    part = S.table(spark, d, "part")
    phrases = part.selectExpr("p_name ord", "p_name phrase").distinct()
    return texts.fuzzy_phrases(part.select(F.col("p_name").alias("text")), phrases)


SIMILAR = f"""t as (select distinct p_name s from part), r as (select a, b, cast(round_even(100 * (2.0::double * {LCS} / (length(a) + length(b))), 0) as int) ratio from (select x.s a, y.s b from t x, t y))"""


@query(f"with {SIMILAR} select a, b, ratio from r where ratio > 70")
def fuzz_ratio_all(spark, d):
    p = S.table(spark, d, "part").select("p_name").distinct()
    return texts.similar(p.selectExpr("p_name text"), p.selectExpr("p_name phrase")).select(F.col("text").alias("a"), F.col("phrase").alias("b"), "ratio")


@query(f"with {SIMILAR} select a \"text\", min(b) phrase, arg_min(ratio, b) ratio from r where ratio > 70 group by a")
def t2a_fuzzy_phrases_all(spark, d):
    part = S.table(spark, d, "part")
    return texts.fuzzy_phrases(part.select(F.col("p_name").alias("text")), part.selectExpr("p_name ord", "p_name phrase").distinct())


@query("select p_partkey, coalesce(nullif(regexp_extract(p_name, '([a-z]+)e ', 1), ''), p_name) hit from part where regexp_matches(p_name, '([a-z]+)e ')")
def t2b_regex(spark, d):
    return texts.regex_hits(S.table(spark, d, "part").withColumn("text", F.col("p_name")), "([a-z]+)e ").select("p_partkey", "hit")


@query(f"with {FR}, {ORDER} select movie_url, frameset from o where place > 2")
def t2c_skip(spark, d):
    return frames.skip_first(S.frames(spark, d), 2).select("movie_url", "frameset")


@query(f"with {M} select movie_url, \"text\", arg_min(app_id, row(job_id, uid, frameset)) app_id from m group by all")
def t2d_phrases(spark, d):
    return texts.phrases_of(S.matches(spark, d), ["app_id"], ["job_id", "uid", "frameset"])


@query("select p_partkey, translate(p_type || ' lI[]i|{}O.', 'lI[]i|{}O.', '111111110:') fixed from part")
def t13a_digit_repair(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.repair_digits(F.concat("p_type", F.lit(" lI[]i|{}O."))).alias("fixed"))


@query("""with l as (select user_id % 20 log_id, event_id, date_trunc('second', ts) at_ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type line from events)
select event_id, (epoch(at_ts)::bigint - min(epoch(at_ts)::bigint) over (partition by log_id)) % 86400 "second" from l qualify regexp_matches(line, 'click|purchase')""")
def t14_telemetry(spark, d):
    lines = S.table(spark, d, "events").selectExpr("user_id % 20 log_id", "event_id", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_type) line")
    return texts.seconds_into_log(lines, "click|purchase").select("event_id", "second")


COUNTS = f"""{M}, c as (select movie_url, frameset, 2073600 total, sum(case when job_id = 'job_1' then w * h else 0 end)::bigint f_pos, sum(case when job_id = 'job_2' then w * h else 0 end)::bigint f_neg from m group by all),
s as (select *, round_even(greatest(0.0::double, 100.0::double - 100.0::double * f_pos / total - 100.0::double * 20 * f_neg / total), 2) score from c)"""


def _counts(spark, d):
    area = lambda job: F.sum(F.expr(f"case when job_id = '{job}' then cast(w * h as long) else 0L end"))
    return S.matches(spark, d).groupBy(*sets.FRAME).agg(area("job_1").alias("f_pos"), area("job_2").alias("f_neg")).withColumn("total", F.lit(2073600))


@query(f"with {COUNTS} select movie_url, frameset, f_pos, f_neg, score, score < 70 failed from s")
def agg4_frame_score(spark, d):
    return scores.frame_scores(_counts(spark, d)).select("movie_url", "frameset", "f_pos", "f_neg", "score", "failed")


MOVIES = f"{COUNTS}, v as (select movie_url, round_even(avg(score::decimal(12,2)), 2) score, min(score) lowest, max(score) highest, count(*) filter (where score < 70) n_failed, count(*) n_frames from s group by all)"


@query(f"with {MOVIES} select *, n_failed >= 2 or score < 70 failed from v")
def agg5_movie_score(spark, d):
    return scores.movie_scores(scores.frame_scores(_counts(spark, d)))


@query(f"with {MOVIES} select round_even(avg(score::decimal(12,2)), 2) score, min(score) lowest, max(score) highest, bool_or(n_failed >= 2 or score < 70) failed from v")
def agg6_job_score(spark, d):
    return scores.job_score(scores.movie_scores(scores.frame_scores(_counts(spark, d))))


@query(f"with recursive {J}, a as (select id, parent_id ancestor, 1 distance from j where parent_id is not null union all select a.id, j.parent_id, distance + 1 from a join j on j.id = a.ancestor where j.parent_id is not null) select * from a")
def jn13_ancestors(spark, d):
    return jobs.ancestors(S.jobs(spark, d))


@query(f"with {J} select parent_id id, count(*) n_children, case when count(*) filter (where status = 'failed') > 0 then 'abort' when count(*) filter (where status = 'success') = count(*) then 'wrap_up' else 'noop' end \"action\" from j where parent_id is not null group by parent_id")
def agg14_child_status(spark, d):
    return jobs.child_evaluation(S.jobs(spark, d))


@query(f"with {J} select parent_id id, round_even(count(*) filter (where status in ('success', 'failed')) / count(*), 4) done from j where parent_id is not null group by parent_id")
def agg13_progress(spark, d):
    return jobs.progress(S.jobs(spark, d))


@query(f"with {J} select id, owner, row_number() over (partition by owner order by created_on desc, id desc) place from j qualify place <= 50")
def lim2_retention(spark, d):
    return jobs.retained(S.jobs(spark, d), 50).select("id", "owner", "place")


@query(f"with {J} select owner, status, id from j qualify row_number() over (partition by owner, status order by created_on desc, id desc) = 1")
def cat3_latest(spark, d):
    return jobs.latest(S.jobs(spark, d), ["owner", "status"], ["created_on", "id"]).select("owner", "status", "id")


@query("with e as (select distinct l_orderkey % 200 pipeline, l_partkey % 7 src, l_suppkey % 7 dst from lineitem where l_partkey % 7 < l_suppkey % 7), n as (select pipeline, dst, bool_and(src < 3) ok from e group by all) select pipeline, dst node from n where ok")
def dag2_ready(spark, d):
    e = S.table(spark, d, "lineitem").selectExpr("l_orderkey % 200 pipeline", "l_partkey % 7 src", "l_suppkey % 7 dst").where("src < dst").distinct()
    return jobs.ready(e, e.where("src < 3").selectExpr("pipeline", "src node"))


@query("with e as (select distinct l_orderkey % 200 pipeline, l_partkey % 7 src, l_suppkey % 7 dst from lineitem where l_partkey % 7 < l_suppkey % 7) select distinct pipeline, src node from e where (pipeline, src) not in (select pipeline, dst from e)")
def dag1_start(spark, d):
    e = S.table(spark, d, "lineitem").selectExpr("l_orderkey % 200 pipeline", "l_partkey % 7 src", "l_suppkey % 7 dst").where("src < dst")
    return jobs.start_nodes(e)


@query("select l_partkey % 16 r, l_suppkey % 16 g, l_linenumber % 16 b, count(*) n from lineitem group by all having count(*) >= 5")
def t18_colours(spark, d):
    c = S.table(spark, d, "lineitem").selectExpr("l_partkey % 16 r", "l_suppkey % 16 g", "l_linenumber % 16 b")
    return c.groupBy("r", "g", "b").agg(F.count("*").alias("n")).where("n >= 5")


@query("select coalesce(lang, 'all') lang, sum(n_chars)::bigint n_bytes, count(*) n from documents group by grouping sets ((lang), ())")
def src9_listing(spark, d):
    docs = S.table(spark, d, "documents")
    return S.listing(docs, "lang", "n_chars")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """What remains per frameset after adding the scans' matches and taking away the known ones: area, boxes, first ids."""
    m = S.matches(spark, d)
    left = sets.difference(sets.bag_sum(m.where("job_id <> 'job_2'")), m.where("job_id = 'job_2'"))
    return boxes.bounding_box(left).join(boxes.union_area(left), list(sets.FRAME))
