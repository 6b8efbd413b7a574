"""What can be reached in trees of jobs, graphs of pipeline nodes and references between entities.

Edges have columns src and dst (and, where graphs are kept apart, keys). Null ends are no edges; repeated edges count once;
empty tables give empty results. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.shared import stored

#: Paths of one task when they are grouped.
ROWS = 500_000


def closure(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst, distance): every node that can be reached from another one, over the fewest edges.

    Paths are doubled, so the rounds grow with the logarithm of the longest one: once all of up to n edges are known, those of n go on by all
    that begin where they end. Each way is met once, and a node that much leads to is joined over its paths of n edges only.
    A task of the groups has some ROWS of them, however many there are. Cycles end by themselves: a node on one reaches itself.
    """
    k = list(keys)
    paths = stored(edges.where("src is not null and dst is not null").select(*k, "src", "dst").distinct().withColumn("distance", F.lit(1)))
    n = 1
    while not (last := paths.where(F.col("distance") == n)).isEmpty():
        ahead = paths.select(*k, F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("distance").alias("more"))
        twice = stored(last.join(ahead, [*k, "dst"]).select(*k, "src", F.col("end").alias("dst"), (F.col("distance") + F.col("more")).alias("distance")))
        parts = max((paths.count() + twice.count()) // ROWS + 1, paths.sparkSession.sparkContext.defaultParallelism)
        paths = stored(paths.unionByName(twice).repartition(parts, *k, "src", "dst").groupBy(*k, "src", "dst").agg(F.min("distance").alias("distance")))
        n *= 2
    return paths


def climbed(jobs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, above, found): of each job with a parent the nearest of the asked ids (id) strictly above it (found), or, if there is none, the
    uppermost id above it. A parent that is no job counts as uppermost.

    Pointers double their steps each round, so the rounds grow with the logarithm of the depth, and a round has at most a row for
    each job. Of rows that share an id the smallest parent counts. What climbs in a cycle without meeting an asked id finds nothing
    (above is null).
    """
    j = stored(jobs.where("id is not null and parent_id is not null").groupBy("id").agg(F.min("parent_id").alias("above")))
    stop = F.lit(False)
    at = j
    if asked is not None:
        at = j.join(asked.where("id is not null").select(F.col("id").alias("above"), F.lit(True).alias("hit")).distinct(), "above", "left")
        stop = F.coalesce("hit", F.lit(False))
    at = at.join(j.select(F.col("id").alias("above"), F.lit(True).alias("more")), "above", "left").select("id", "above", stop.alias("found"), (~stop & F.coalesce("more", F.lit(False))).alias("going"))
    at = stored(at)
    for _ in range(max(1, at.count()).bit_length() + 1):
        going = at.where("going")
        if going.isEmpty():
            break
        there = at.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("found").alias("hit"), F.col("going").alias("on"))
        moved = going.select("id", "above").join(there, "above").select("id", F.col("next").alias("above"), F.col("hit").alias("found"), F.col("on").alias("going"))
        at = stored(at.where("not going").unionByName(moved))
    return at.select("id", F.when(~F.col("going"), F.col("above")).alias("above"), "found")


def subtree(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): each of the roots (id) with itself and all jobs below it, once.

    Every job climbs to the nearest root above it; roots below other roots are told for those as well. So the work grows with the jobs and with
    what comes out, not with all pairs of jobs above each other.
    """
    r = stored(roots.where("id is not null").select(F.col("id").alias("root")).distinct())
    near = stored(climbed(jobs, r.select(F.col("root").alias("id"))).where("found").select("id", F.col("above").alias("near")))
    over = closure(near.join(r.select(F.col("root").alias("id")), "id", "left_semi").select(F.col("id").alias("src"), F.col("near").alias("dst")))
    over = r.select("root", F.col("root").alias("near")).unionByName(over.select(F.col("dst").alias("root"), F.col("src").alias("near"))).distinct()
    return r.select("root", F.col("root").alias("id")).unionByName(near.join(over, "near").where("root <> id").select("root", "id"))


def tops(jobs: DataFrame) -> DataFrame:
    """(id, root): the uppermost job above each job, itself if it has no parent (or climbs in a cycle). A parent that is no job counts as root."""
    return jobs.select("id").join(climbed(jobs).select("id", "above"), "id", "left").select("id", F.coalesce("above", "id").alias("root"))


def rolled_up(jobs: DataFrame, value: str) -> DataFrame:
    """(root, n_jobs, values): the distinct values (null ones left out) of a column over all jobs below a root, sorted."""
    return jobs.select("id", value).join(tops(jobs), "id").groupBy("root").agg(F.count("*").alias("n_jobs"), F.array_sort(F.collect_set(value)).alias("values"))


def below(jobs: DataFrame, value: str) -> DataFrame:
    """(id, values): the distinct values (null ones left out) of a column of each job and all jobs below it, sorted.

    In round k every job hands what it knows of the jobs up to 2^k - 1 steps below it to the one 2^k steps above, so the rounds grow with the logarithm
    of the depth and their rows with the values that come out.
    """
    up = stored(jobs.where("id is not null and parent_id is not null").groupBy("id").agg(F.min("parent_id").alias("above")))
    own = stored(jobs.where("id is not null").select("id", F.col(value).alias("value")).where("value is not null").distinct())
    for _ in range(max(1, up.count()).bit_length() + 1):
        if up.isEmpty():
            break
        own = stored(own.unionByName(own.join(up, "id").select(F.col("above").alias("id"), "value")).distinct())
        up = stored(up.join(up.select(F.col("id").alias("above"), F.col("above").alias("further")), "above").select("id", F.col("further").alias("above")))
    ids = jobs.select("id").where("id is not null").distinct()
    values = own.groupBy("id").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return ids.join(values, "id", "left").select("id", F.coalesce("values", F.array().cast(dict(values.dtypes)["values"])).alias("values"))


def reached(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node): the starts (keys, node) and everything that edges (keys, src, dst) lead to from them, each once.

    From the starts outwards: a round follows the edges of what the last one has found for the first time, so that nothing is
    looked at that isn't asked for; as many rounds as the farthest node has steps. Cycles end by themselves.
    """
    k = list(keys)
    e = edges.where("src is not null and dst is not null").select(*k, F.col("src").alias("node"), "dst")
    seen = new = stored(starts.where("node is not null").select(*k, "node").distinct())
    while True:
        ahead = new.join(e, [*k, "node"]).select(*k, F.col("dst").alias("node")).distinct()
        new = stored(ahead.join(seen, [*k, "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def levels(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, node, depth): the depths at which each node of a graph occurs, from its start nodes (depth 0) on.

    A node has as many rows as there are lengths of ways to it. A cycle would have no end: after more rounds than a
    graph has nodes an error is raised.
    """
    k = list(keys)
    e = stored(edges.where("src is not null and dst is not null").select(*k, "src", "dst").distinct())
    most = e.select(*k, F.explode(F.array("src", "dst")).alias("n")).groupBy(*k).agg(F.count_distinct("n").alias("n")).agg(F.max("n")).first()[0] or 0
    start = e.select(*k, "src").distinct().join(e.select(*k, F.col("dst").alias("src")).distinct(), [*k, "src"], "left_anti")
    out = level = stored(start.select(*k, F.col("src").alias("node"), F.lit(0).alias("depth")))
    for depth in range(1, most + 1):
        level = stored(level.select(*k, F.col("node").alias("src")).join(e, [*k, "src"]).select(*k, F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    if most:
        raise ValueError("the graph has a cycle")
    return out


def restarted(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, node): the nodes that are asked to restart and all that come after them, whose jobs have to go."""
    return reached(edges, nodes, keys)


def export_closure(roots: DataFrame, references: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity (id, other columns) that the roots (id) refer to, directly or not, and the roots; each id once.

    references: (src, dst). Ids without an entity are left out; of entities that share an id the smallest row counts.
    """
    ids = reached(references, roots.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    one = entities.groupBy("id").agg(F.min(F.struct(*[c for c in entities.columns if c != "id"])).alias("e")) if len(entities.columns) > 1 else entities.distinct()
    found = one.join(ids, "id", "left_semi")
    return found.select("id", "e.*") if len(entities.columns) > 1 else found


def percent_complete(jobs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, done): 1 for jobs that have ended, 0 for those just created, else what their children add up to.

    jobs: id, parent_id, status, operation, anticipated (children to come, null: unknown). A child adds its own share,
    times the weight of its operation (1), divided by the number of children or, if that is more, by what is
    anticipated. Running jobs without children are at 0. Worked out level by level from the leaves, one round a level.
    """
    weight = F.lit(1.0)
    for op, w in (weights or {}).items():
        weight = F.when(F.col("operation") == op, F.lit(float(w))).otherwise(weight)
    state = F.when(F.col("status").isin("success", "failed", "bypassed", "purged"), F.lit(1.0)).when(F.col("status") == "created", F.lit(0.0))
    j = stored(jobs.select("id", "parent_id", "anticipated", weight.alias("weight"), state.alias("done")))
    kids = j.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n")).where("id is not null")
    j = stored(j.join(kids, "id", "left").withColumn("done", F.when(F.col("done").isNull() & F.col("n").isNull(), 0.0).otherwise(F.col("done"))))
    while True:
        waiting = j.where("done is null")
        left = waiting.count()
        if not left:
            return j.select("id", "done")
        own = j.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("done").isNull()).alias("open"), F.sum(F.col("done") * F.col("weight")).alias("sum"))
        full = waiting.drop("done").join(own, "id").select("id", "parent_id", "anticipated", "weight", F.when(F.col("open") == 0, F.col("sum") / F.greatest("n", F.coalesce("anticipated", "n"))).alias("done"), "n")
        j = stored(j.where("done is not null").select("id", "parent_id", "anticipated", "weight", "done", "n").unionByName(full))
        if j.where("done is null").count() == left:
            raise ValueError("jobs are their own ancestors")


def worth_telling(old: str, new: str, status: str, least: float = 0.05):
    """The progress that is kept: the new one if it differs enough, or for the first sign of life; else the old one."""
    return F.expr(f"case when {old} = 0 and {status} = 'running' then {new} when abs({old} - {new}) > {least} then {new} else {old} end")
