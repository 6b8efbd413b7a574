"""Queries over jobs, pipelines, scanners and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import frames, graphs, jobs, sets
from veilframe.plans.registry import plain, query
from veilframe.sources import archive
from veilframe.sources import tables as S

M, FR, J = S.MATCHES_SQL, S.FRAMES_SQL, S.JOBS_SQL
NODES = "(select distinct l_orderkey % 200 pipeline, l_partkey % 7 src, l_suppkey % 7 dst from lineitem where l_partkey % 7 < l_suppkey % 7)"


def _edges(spark, d):
    return S.table(spark, d, "lineitem").selectExpr("l_orderkey % 200 pipeline", "l_partkey % 7 src", "l_suppkey % 7 dst").where("src < dst").distinct()


@query(f"with recursive {J}, t as (select id root, id from j where parent_id is null and status = 'failed' union all select root, j.id from t join j on j.parent_id = t.id) select root, id from t")
def jn18_delete_tree(spark, d):
    j = S.jobs(spark, d)
    return graphs.subtree(j, j.where("parent_id is null and status = 'failed'"))


ROOTS = f"{J}, up as (select id, id top, parent_id p from j union all select up.id, p, j.parent_id from up left join j on j.id = p where p is not null), r as (select id, top root from up where p is null)"


@query(f"with recursive {ROOTS} select root, count(*) n_jobs, string_agg(distinct owner::varchar, ',' order by owner::varchar) owners from r join j using (id) group by root")
def agg15_rollup(spark, d):
    rows = graphs.rolled_up(S.jobs(spark, d).withColumn("who", F.col("owner").cast("string")), "who")
    return rows.select("root", "n_jobs", F.array_join("values", ",").alias("owners"))


@query(f"with recursive {J}, t as (select id root, id from j union all select root, j.id from t join j on j.parent_id = t.id) select root id, string_agg(distinct 'dir' || (owner % 5), ',' order by 'dir' || (owner % 5)) dirs from t join j using (id) group by root")
def agg16_dirs(spark, d):
    j = S.jobs(spark, d).withColumn("dir", F.expr("concat('dir', owner % 5)"))
    return graphs.below(j, "dir").select("id", F.array_join("values", ",").alias("dirs"))


@query(f"with recursive e as {NODES}, l as (select distinct pipeline, src node, 0 depth from e where (pipeline, src) not in (select pipeline, dst from e) union select e.pipeline, e.dst, depth + 1 from l join e on e.pipeline = l.pipeline and e.src = l.node) select * from l")
def dag3_levels(spark, d):
    return graphs.levels(_edges(spark, d), ("pipeline",))


@query(f"with recursive e as {NODES}, l as (select distinct pipeline, src node from e where src = 2 union select e.pipeline, e.dst from l join e on e.pipeline = l.pipeline and e.src = l.node) select * from l")
def dag4_restart(spark, d):
    e = _edges(spark, d)
    return graphs.restarted(e, e.where("src = 2").selectExpr("pipeline", "src node"), ("pipeline",))


REFS = """x as (select 'job:' || l_orderkey src, 'scanner:' || l_partkey dst from lineitem union select 'scanner:' || l_partkey, 'movie:' || l_suppkey from lineitem where l_linenumber = 1)"""


@query(f"with recursive {REFS}, t as (select 'job:' || o_orderkey id from orders where o_custkey % 50 = 3 union select dst from t join x on x.src = t.id) select id from t")
def snk5_export(spark, d):
    lines = S.table(spark, d, "lineitem")
    refs = lines.selectExpr("concat('job:', l_orderkey) src", "concat('scanner:', l_partkey) dst").unionByName(lines.where("l_linenumber = 1").selectExpr("concat('scanner:', l_partkey) src", "concat('movie:', l_suppkey) dst"))
    asked = S.table(spark, d, "orders").where("o_custkey % 50 = 3").selectExpr("concat('job:', o_orderkey) id")
    entities = refs.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(asked).distinct()
    return graphs.export_closure(asked, refs, entities)


WORK = "w as (select id, parent_id, case when status = 'running' and id % 5 = 0 then 'created' else status end status, 'op' || (id % 3) operation, id % 4 anticipated from j)"


def _work(spark, d):
    return S.jobs(spark, d).selectExpr("id", "parent_id", "case when status = 'running' and id % 5 = 0 then 'created' else status end status", "concat('op', id % 3) operation", "id % 4 anticipated", "created_on", "owner")


@query(f"""with recursive {J}, {WORK}, k as (select parent_id id, count(*) n from w group by all), t as (select id root, id, 1.0::double share from w union all
select root, w.id, share * (case w.operation when 'op0' then 0.5 when 'op1' then 1.5 else 1 end) / greatest(k.n, p.anticipated) from t join w p on p.id = t.id and p.status = 'running' join k on k.id = t.id join w on w.parent_id = t.id)
select root id, round(sum(case when status in ('success', 'failed') then share else 0 end), 6) done from t join w using (id) group by root""")
def agg13_percent(spark, d):
    return graphs.percent_complete(_work(spark, d), {"op0": 0.5, "op1": 1.5}).select("id", F.round("done", 6).alias("done"))


@query(f"""with {J}, {WORK}, k as (select parent_id id, count(*) n, count(*) filter (where status = 'failed') bad, count(*) filter (where status = 'success') good from w where operation = 'op1' group by all)
select w.id, coalesce(n, 0)::int n_children, case when n is null then 'build_child_tasks' when good = n then 'wrap_up' when bad > 0 then 'abort' else 'noop' end "action" from w left join k using (id)""")
def agg14_evaluate(spark, d):
    return jobs.evaluated(_work(spark, d), "op1").withColumn("n_children", F.col("n_children").cast("int"))


@query(f"with {J}, r as (select * from j where parent_id is null), o as (select * from r where id % 9 <> 0 order by created_on desc, id desc offset greatest(0, 5 - (select count(*) from r where id % 9 = 0))) select id, created_on from o")
def lim2_sweep(spark, d):
    j = S.jobs(spark, d)
    return jobs.swept(j, j.where("id % 9 = 0"), 5).select("id", "created_on")


@query("""with a as (select o_orderkey id, o_orderdate created_on, ['20minutes', '1hours', '8hours', '1days', '7days', '31days', '1day', null][1 + o_orderkey % 8] auto_delete_age from orders),
b as (select unnest(['20minutes', '1hours', '8hours', '1days', '7days', '31days']) auto_delete_age, unnest([20, 60, 480, 1440, 10080, 44640]) m)
select id, auto_delete_age from a join b using (auto_delete_age) where epoch(timestamp '1995-06-17 12:00:00') - epoch(created_on::timestamp) > 60 * m""")
def cat7_expiry(spark, d):
    ages = "element_at(array('20minutes', '1hours', '8hours', '1days', '7days', '31days', '1day', null), cast(1 + o_orderkey % 8 as int))"
    j = S.table(spark, d, "orders").selectExpr("o_orderkey id", "cast(null as long) parent_id", "o_orderdate created_on", f"{ages} auto_delete_age")
    return jobs.expired(j, "1995-06-17 12:00:00").select("id", "auto_delete_age")


ATTRS = "a as (select o_orderkey job_id, 'auto_delete_age' \"name\", '7days' \"value\" from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'lob', 'L' || (o_custkey % 4) from orders)"


def _attributes(spark, d):
    o = S.table(spark, d, "orders")
    ages = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey job_id", "'auto_delete_age' name", "'7days' value")
    return ages.unionByName(o.selectExpr("o_orderkey job_id", "'lob' name", "concat('L', o_custkey % 4) value"))


@query(f"with {ATTRS} select * from a where \"name\" <> 'auto_delete_age' or job_id % 3 <> 0 union all select o_orderkey, 'auto_delete_age', 'never' from orders where o_orderkey % 3 = 0")
def cat8_preserve(spark, d):
    return jobs.preserved(_attributes(spark, d), S.table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey job_id"))


@query(f"with {ATTRS} select job_id, string_agg(\"name\" || '=' || \"value\", ';' order by \"name\") attrs from a group by job_id")
def agg20_attributes(spark, d):
    rows = jobs.attributes_of(_attributes(spark, d), "job_id")
    return rows.select("job_id", F.expr("array_join(transform(map_entries(attributes), e -> concat(e.key, '=', e.value)), ';')").alias("attrs"))


@query(f"with {J} select parent_id id, string_agg('error ' || id, ';' order by id) errors from j where parent_id is not null and status = 'failed' group by parent_id")
def agg19_errors(spark, d):
    j = S.jobs(spark, d).withColumn("errors", F.expr("case when status = 'failed' then array(concat('error ', id)) else array() end"))
    return jobs.harvested_errors(j).select("id", F.array_join("errors", ";").alias("errors"))


@query(f"""with {J}, {ATTRS}, k as (select parent_id id, string_agg(id::varchar, ',' order by id) children from j where parent_id is not null group by all), x as (select job_id id, count(*) n from a group by all)
select j.id, status, owner, length('request ' || j.id)::int request_size, coalesce(length(case when status = 'success' then 'response ' || j.id end), 0)::int response_size, coalesce(children, '') children, x.n::int n_attributes from j left join k using (id) left join x using (id)""")
def prj2_jobs(spark, d):
    j = S.jobs(spark, d).withColumn("request", F.expr("concat('request ', id)")).withColumn("response", F.expr("case when status = 'success' then concat('response ', id) end"))
    return jobs.listed(j, _attributes(spark, d)).select("id", "status", "owner", "request_size", "response_size", F.array_join("children", ",").alias("children"), F.size("attributes").alias("n_attributes"))


@query(f"with {J} select id, status, created_on from j where owner = 3")
def flt8_jobs_by_owner(spark, d):
    return S.jobs(spark, d).where("owner = 3").select("id", "status", "created_on")


@query("""with c as (select p_partkey job_id, 'k' || (p_size % 3) "name", 'old' "value" from part), w as (select p_partkey job_id, 'k' || (p_partkey % 3) "name", 'new' "value" from part)
select * from c where (job_id, "name") in (select job_id, "name" from w) union all select * from w where (job_id, "name") not in (select job_id, "name" from c)""")
def cat4_sync(spark, d):
    p = S.table(spark, d, "part")
    return jobs.synchronised(p.selectExpr("p_partkey job_id", "concat('k', p_size % 3) name", "'old' value"), p.selectExpr("p_partkey job_id", "concat('k', p_partkey % 3) name", "'new' value"), "job_id")


@query("""select p_partkey id, p_name "name", 'old' v from part where p_partkey % 4 <> 0 union all select p_partkey, upper(p_name), 'new' from part where p_partkey % 4 = 0 union all select p_partkey + 10000000, p_name, 'new' from part where p_partkey % 10 = 1""")
def src12_import(spark, d):
    p = S.table(spark, d, "part")
    new = p.where("p_partkey % 4 = 0").selectExpr("p_partkey id", "upper(p_name) name", "'new' v").unionByName(p.where("p_partkey % 10 = 1").selectExpr("p_partkey + 10000000 id", "p_name name", "'new' v"))
    return jobs.imported(p.selectExpr("p_partkey id", "p_name name", "'old' v"), new, ["id"])


@query(f"with {FR} select movie_url, ceil(count(distinct frameset) / 2)::bigint n_tasks from f group by all")
def agg17_anticipated(spark, d):
    return jobs.anticipated(S.frames(spark, d), 2)


@query(f"""with {M}, n as (select unnest(['job_0', 'job_1', 'job_2', 'job_9']) node), o as (select job_id node, count(*) k from (select distinct job_id, movie_url, frameset from m where app_id <> 'Brand#1') group by all), i as (select job_id node, count(*) k from (select distinct job_id, movie_url, frameset from m) group by all)
select node, case when node = 'job_9' then 'not yet created' else 'running' end status, case when node = 'job_9' then 0 else 37 end::bigint percent, coalesce(i.k, 0)::bigint framesets_in, coalesce(o.k, 0)::bigint framesets_out from n left join i using (node) left join o using (node)""")
def agg18_nodes(spark, d):
    m = S.matches(spark, d).withColumn("node", F.col("job_id"))
    nodes = spark.createDataFrame([("job_0",), ("job_1",), ("job_2",), ("job_9",)], "node string")
    state = spark.createDataFrame([("job_0", "running", 0.37), ("job_1", "running", 0.374), ("job_2", "running", 0.3712)], "node string, status string, percent_complete double")
    return jobs.node_status(nodes, state, m, m.where("app_id <> 'Brand#1'"))


@query("""select p_partkey id, p_type, case when p_partkey % 2 = 0 then p_size % 5 end::int num_anchors, case when p_partkey % 2 = 1 then replace(p_name, ' ', ',') end match_text, (70 + p_size % 20)::int match_percent from part""")
def prj1_scanners(spark, d):
    p = S.table(spark, d, "part")
    anchors = "transform(filter(sequence(0, 5), i -> i < p_size % 5), i -> named_struct('id', i))"
    content = f"case when p_partkey % 2 = 0 then to_json(named_struct('anchors', {anchors}, 'match_percent', 70 + p_size % 20)) else to_json(named_struct('match_text', split(p_name, ' '), 'match_percent', 70 + p_size % 20)) end"
    kind = "case when p_partkey % 2 = 0 then 'template' else 'ocr' end"
    return archive.scanner_metadata(p.selectExpr("p_partkey id", f"{kind} type", f"{content} content", "p_type")).select("id", "p_type", "num_anchors", "match_text", "match_percent")


@query("select p_partkey id from part where p_type like '%A%' and 'color' || (p_size % 7) = 'color3'")
def flt9_scanner_search(spark, d):
    p = S.table(spark, d, "part")
    attrs = p.selectExpr("p_partkey id", "'color' name", "concat('color', p_size % 7) value")
    return archive.scanners_with(p.selectExpr("p_partkey id", "p_type type"), attrs, "type like '%A%'", "color", "color3").select("id")


@query(f"with {M} select uid, 'http://host/' || case movie_url when 'm1' then 'n1' when 'm3' then 'n3' else movie_url end || '/f_' || frameset || '.png' url from m")
def cat5_rebase(spark, d):
    urls = S.matches(spark, d).selectExpr("uid", "concat('http://host/', movie_url, '/f_', frameset, '.png') url")
    moves = spark.createDataFrame([("m1", "n1"), ("m3", "n3"), (None, "x")], "old string, new string")
    return archive.rebased(urls, "url", moves).select("uid", "url")


@query("""select p_partkey id, case when p_size % 4 = 1 then 'data_redacted' else 'no_redaction_data_found' end kind from part where p_size % 5 <> 0""")
def snk10_events(spark, d):
    p = S.table(spark, d, "part").selectExpr("p_partkey id", "case when p_size % 5 <> 0 then 'account' end account", "'lob' lob", "p_size % 4 = 1 redacted")
    return jobs.complete_events(p, ["account", "lob"]).select("id", "kind")


@query("select 'src' || p_partkey source_id, 'new' || p_partkey new_id, 'redaction: src' || p_partkey source_name from part where p_size % 3 = 0 and p_size % 4 <> 0 and p_size % 5 <> 0")
def snk7_receipts(spark, d):
    p = S.table(spark, d, "part").selectExpr("case when p_size % 3 = 0 then 'success' end status", "case when p_size % 4 <> 0 then concat('src', p_partkey) end source_id", "case when p_size % 5 <> 0 then concat('new', p_partkey) else '' end new_id")
    return jobs.receipts(p)


@query(f"with recursive {J}, t as (select id root, id from j where status = 'failed' union all select root, j.id from t join j on j.parent_id = t.id) select distinct id, status from t join j using (id) where id <> root and status <> 'running'")
def snk11_purge(spark, d):
    j = S.jobs(spark, d).withColumn("status", F.expr("case when status = 'running' then 'bypassed' else status end"))
    return jobs.purged(j, j.where("status = 'failed'")).select("id", "status")


@query(f"""with {M}, u as (select distinct 'x/' || movie_url || '_' || job_id || '.mp4' url from m), n as (select distinct movie_url needle from m union select 'm1_job') select url, needle from u join n on contains(url, needle)""")
def jn11_contains(spark, d):
    m = S.matches(spark, d)
    urls = m.selectExpr("concat('x/', movie_url, '_', job_id, '.mp4') url").distinct()
    return sets.containing(urls, "url", m.selectExpr("movie_url needle").unionByName(m.selectExpr("'m1_job' needle")).distinct(), "needle")


@query(f"""with {M}, a as (select movie_url, frameset, case when frameset % 3 = 0 then 'desired' else 'unwanted' end mark from m where frameset % 2 = 0 group by all)
select uid, coalesce(mark, 'none') mark from m left join a using (movie_url, frameset)""")
def jn12_annotations(spark, d):
    m = S.matches(spark, d)
    marks = m.where("frameset % 2 = 0").select(*sets.FRAME).distinct().withColumn("mark", F.expr("case when frameset % 3 = 0 then 'desired' else 'unwanted' end"))
    return m.join(marks, list(sets.FRAME), "left").select("uid", F.coalesce("mark", F.lit("none")).alias("mark"))


@query("select event_id recording from events where event_type = 'click' and event_id not in (select event_id from events where value > 40)")
def jn14_unreceived(spark, d):
    e = S.table(spark, d, "events")
    return sets.unmatched(e.where("event_type = 'click'").selectExpr("event_id recording"), e.where("value > 40").selectExpr("event_id recording"), ["recording"])


@query(f"with {FR} select event_id, image from f where image not in (select image from f where value > 80)")
def jn15_untrained(spark, d):
    f = S.frames(spark, d)
    return sets.unmatched(f, f.where("value > 80"), ["image"]).select("event_id", "image")


@query(f"with {M} select movie_url, frameset, match_id, arg_max(uid, row(job_id, uid)) uid from m group by all")
def set6_fan_in(spark, d):
    return sets.fan_in(S.matches(spark, d), ["movie_url", "frameset", "match_id"], ["job_id", "uid"]).select("movie_url", "frameset", "match_id", "uid")


@query(f"with {M}, l as (select movie_url, frameset, max(job_id) job_id from m group by all) select movie_url, frameset, uid from m join l using (movie_url, frameset, job_id)")
def set7_replace_framesets(spark, d):
    return sets.replaced(S.matches(spark, d), ["movie_url", "frameset"], "job_id").select("movie_url", "frameset", "uid")


@query(f"with {M} select uid, 'job_0' into_job from m where job_id = 'job_0' union all select uid, 'job_0' from m where job_id = 'job_1' and (movie_url, frameset) in (select movie_url, frameset from m where job_id = 'job_0')")
def set9_carry_ocr(spark, d):
    m = S.matches(spark, d)
    return sets.carried_in(m.where("job_id = 'job_0'"), m.where("job_id = 'job_1'")).select("uid", F.lit("job_0").alias("into_job"))


@query(f"with {FR} select movie_url, frameset, string_agg(image, ',' order by image) images from f group by all")
def hsh4_gather(spark, d):
    return frames.gathered(S.frames(spark, d)).select("movie_url", "frameset", F.array_join("images", ",").alias("images"))


@query(f"with {FR} select movie_url, frameset, count(*) n_frames, min(ts) first_ts from f group by all")
def hsh3_partial_final(spark, d):
    return frames.merged_batches(frames.hashed_batches(S.frames(spark, d), 50)).select("movie_url", "frameset", "n_frames", "first_ts")


@query(f"with {FR} select movie_url, case when frameset = 'click' then 'view' else frameset end frameset, count(*) n_frames from f group by all")
def hsh6_merge(spark, d):
    return frames.framesets(frames.merge_framesets(S.frames(spark, d), "view", "click")).select("movie_url", "frameset", "n_frames")


@query(f"with {FR} select event_id from f where not (movie_url = 'm1' and frameset = 'click')")
def hsh8_remove(spark, d):
    f = S.frames(spark, d)
    gone = spark.createDataFrame([("m1", "click")], "movie_url string, frameset string")
    return frames.without(f, gone).select("event_id")


@query(f"with {FR} select event_id, image, null::varchar redacted_image from f")
def hsh9_clear(spark, d):
    return frames.cleared(S.frames(spark, d).withColumn("redacted_image", F.col("image")), "redacted_image").select("event_id", "image", "redacted_image")


@query(f"with {M} select movie_url, frameset, max(job_id) job_id, count(*) n from m group by all having count(distinct job_id) = 3")
def t1e_all_anchors(spark, d):
    return sets.all_anchors(S.matches(spark, d).withColumn("anchor_id", F.col("job_id")), ["job_0", "job_1", "job_2"]).groupBy(*sets.FRAME).agg(F.max("job_id").alias("job_id"), F.count("*").alias("n"))


@query(f"with {J} select id, printf('%d:%02d:%02d', (s % 86400) // 3600, s % 3600 // 60, s % 60) took from (select id, (id * 977) % 200000 s from j)")
def fn_wall_clock(spark, d):
    return S.jobs(spark, d).select("id", T.wall_clock(F.expr("(id * 977) % 200000")).alias("took"))


@query("""with s as (select o_orderkey id, (o_orderkey * 7919) % 100000000 s from orders), t as (select id, s // 86400 d, s % 86400 r from s)
select id, case when d = 0 and r < 10 then 'just now' when d = 0 and r < 60 then r || ' seconds ago' when d = 0 and r < 120 then 'a minute ago' when d = 0 and r < 3600 then r // 60 || ' minutes ago' when d = 0 and r < 7200 then 'an hour ago'
when d = 0 then r // 3600 || ' hours ago' when d = 1 then 'yesterday' when d < 7 then d || ' days ago' when d < 31 then d // 7 || ' weeks ago' when d < 365 then d // 30 || ' months ago' else d // 365 || ' years ago' end said from t""")
def fn_pretty_age(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.pretty_age(F.expr("(o_orderkey * 7919) % 100000000")).alias("said"))


@query("select p_partkey id, p_name from part")
def fn_base64url(spark, d):
    coded = S.table(spark, d, "part").select("p_partkey", F.regexp_replace(F.translate(F.base64(F.encode("p_name", "utf-8")), "+/", "-_"), "=+$", "").alias("c"))
    return coded.select(F.col("p_partkey").alias("id"), F.decode(T.from_base64url("c"), "utf-8").alias("p_name"))


@query(f"with {M} select distinct movie_url, frameset, frameset % 3 n_areas from m")
def snk8_metadata(spark, d):
    meta = S.matches(spark, d).select(*sets.FRAME, F.expr("frameset % 3").alias("n_areas")).distinct()
    return archive.metadata_round_trip(meta)


@plain
def agg21_pivot(spark, d):
    """Attributes of pipelines by name, and the jobs they are linked to."""
    a = _attributes(spark, d).withColumn("pipeline", F.expr("job_id % 50"))
    return archive.with_attributes(a.select("pipeline").distinct(), a, a.select("pipeline", "job_id").distinct())


@query("""with n as (select p_partkey node, ['ocr', 'template', 'zip', 'other', 'pipeline'][1 + p_partkey % 5] "type", p_size entity_id from part), s as (select p_size id, min(p_name) "name" from part where p_size % 2 = 0 group by all)
select node, "type", case "type" when 'ocr' then 'OCR' when 'template' then 'T' when 'zip' then 'Z' when 'pipeline' then 'P' else '?' end short, case when s.name is not null and "type" in ('ocr', 'template', 'pipeline') then "type" || ' - ' || s.name else "type" end task from n left join s on s.id = entity_id""")
def cat9_described(spark, d):
    p = S.table(spark, d, "part")
    nodes = p.selectExpr("p_partkey node", "element_at(array('ocr', 'template', 'zip', 'other', 'pipeline'), cast(1 + p_partkey % 5 as int)) type", "p_size entity_id")
    return jobs.described(nodes, p.where("p_size % 2 = 0").selectExpr("p_size id", "p_name name"))


@query(f"with recursive {ROOTS}, a as (select id, 'n' || (id % 6) node from j where id % 2 = 0) select root, node, arg_max(id, row(created_on, id)) id from a join r using (id) join j using (id) group by all")
def jn13_node_jobs(spark, d):
    j = S.jobs(spark, d)
    attrs = j.where("id % 2 = 0").selectExpr("id job_id", "'node_id' name", "concat('n', id % 6) value")
    return jobs.jobs_of_nodes(j, attrs, graphs.tops(j))


@query(f"with {FR} select movie_url, frameset, string_agg(image, ',' order by ts, event_id) images from f group by all")
def hsh2_images(spark, d):
    return frames.images_in_order(S.frames(spark, d)).select("movie_url", "frameset", F.array_join("images", ",").alias("images"))


@query(f"""with {FR}, o as (select *, row_number() over (partition by movie_url order by first_ts, frameset) place from (select movie_url, frameset, min(ts) first_ts from f group by all)), s as (select movie_url, place stop from o where frameset = 'click')
select event_id from f join o using (movie_url, frameset) left join s using (movie_url) where stop is null or place < stop""")
def hsh7_matches(spark, d):
    f = S.frames(spark, d)
    return frames.matches_before(f, f, "click").select("event_id")


@query(f"with {J} select owner, id, row_number() over (partition by owner order by created_on desc, id desc) place from j where parent_id is null")
def flt8_roots_by_owner(spark, d):
    """Each owner's root jobs, numbered from the newest."""
    return jobs.roots_by_owner(S.jobs(spark, d)).select("owner", "id", "place")


@query("select p_partkey id, 'rec' || p_partkey recording from part")
def fn_recording_id(spark, d):
    """Recordings' names out of the addresses of their files."""
    url = F.concat(F.lit("https://files/x_y/rec"), F.col("p_partkey"), F.lit("_"), F.col("p_size"), F.lit("_full.mp4"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.recording_id(url).alias("recording"))
