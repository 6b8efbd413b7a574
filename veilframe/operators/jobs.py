"""Trees of jobs, graphs of pipeline nodes, retention and status.

Jobs without a parent are roots; a null id is no job's parent. Null statuses are neither success nor failure. Ties of time go by
the larger id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.operators.graphs import closure, subtree


def ancestors(jobs: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every job and each job above it, at any depth."""
    return closure(jobs.select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))).select(F.col("src").alias("id"), F.col("dst").alias("ancestor"), "distance")


def child_evaluation(jobs: DataFrame) -> DataFrame:
    """What to do with each parent: abort (a child failed), wrap_up (all succeeded), noop."""
    kids = jobs.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "success").alias("good"))
    return kids.selectExpr("parent_id id", "n n_children", "case when bad > 0 then 'abort' when good = n then 'wrap_up' else 'noop' end action")


def progress(jobs: DataFrame) -> DataFrame:
    """Share of a parent's children that have ended."""
    return jobs.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.bround(F.count_if(F.col("status").isin("success", "failed")) / F.count("*"), 4).alias("done"))


def roots_by_owner(jobs: DataFrame) -> DataFrame:
    """Newest root jobs of each owner, numbered from the newest."""
    return jobs.where("parent_id is null").withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("created_on").desc(), F.col("id").desc())))


def retained(jobs: DataFrame, keep: int) -> DataFrame:
    """Of each owner's jobs the `keep` newest."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.col("created_on").desc(), F.col("id").desc()))
    return jobs.withColumn("place", place).where(F.col("place") <= keep)


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Upsert: of the rows that share keys the last by the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by]))).where("__n = 1").drop("__n")


def ready(edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes (pipeline, dst) all of whose inbound edges come from nodes that are done."""
    d = done.select("pipeline", F.col("node").alias("src"), F.lit(True).alias("ok")).distinct()
    return edges.join(d, ["pipeline", "src"], "left").groupBy("pipeline", "dst").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready")).where("ready").select("pipeline", F.col("dst").alias("node"))


def start_nodes(edges: DataFrame) -> DataFrame:
    inbound = edges.select("pipeline", F.col("dst").alias("src")).distinct()
    return edges.select("pipeline", "src").distinct().join(inbound, ["pipeline", "src"], "left_anti").select("pipeline", F.col("src").alias("node"))


def evaluated(jobs: DataFrame, child_operation: str) -> DataFrame:
    """(id, n_children, action) of every job, by its children of one operation: build_child_tasks (none yet), wrap_up (all
    succeeded), abort (one failed), noop. Jobs whose parent_id is null are nobody's children; null statuses are open."""
    kids = jobs.where(F.col("parent_id").isNotNull() & (F.col("operation") == child_operation))
    kids = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "success").alias("good"))
    n = F.coalesce("n", F.lit(0))
    action = F.when(n == 0, "build_child_tasks").when(F.col("good") == n, "wrap_up").when(F.col("bad") > 0, "abort").otherwise("noop")
    return jobs.select("id").join(kids, "id", "left").select("id", n.alias("n_children"), action.alias("action"))


def swept(jobs: DataFrame, never: DataFrame, keep: int) -> DataFrame:
    """Root jobs that have to go: all but the `keep` newest, where roots that must never go (never: id) take places first.

    Ties of created_on go by the larger id. The newest are found by a top-k, the rest by an anti-join.
    """
    roots = jobs.where("parent_id is null")
    sacred = roots.join(never.select("id").distinct(), "id", "left_semi")
    others = roots.join(never.select("id").distinct(), "id", "left_anti")
    room = max(0, keep - sacred.count())
    newest = others.orderBy(F.col("created_on").desc_nulls_last(), F.col("id").desc()).limit(room).select("id")
    return others.join(newest, "id", "left_anti")


#: Ages after which jobs go, by their auto_delete_age (fixed values); other words never expire.
AGES = {"20minutes": 20, "1hours": 60, "8hours": 480, "1days": 1440, "7days": 10080, "31days": 44640}


def expired(jobs: DataFrame, now: str) -> DataFrame:
    """Root jobs whose age at `now` is over their auto_delete_age. Null ages, dates and unknown words never expire."""
    minutes = F.lit(None).cast("int")
    for word, m in AGES.items():
        minutes = F.when(F.col("auto_delete_age") == word, m).otherwise(minutes)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created_on").cast("timestamp"))
    return jobs.where("parent_id is null").where(age > minutes * 60)


def preserved(attributes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Attributes (job_id, name, value) after the jobs (job_id) have been marked never to be deleted: older ages of theirs go."""
    keep = jobs.select("job_id").distinct()
    age = F.col("name") == "auto_delete_age"
    rest = attributes.where(~F.coalesce(age, F.lit(False))).unionByName(attributes.where(age).join(keep, "job_id", "left_anti").select(*attributes.columns))
    return rest.unionByName(keep.select("job_id", F.lit("auto_delete_age").alias("name"), F.lit("never").alias("value")))


def harvested_errors(jobs: DataFrame) -> DataFrame:
    """(id, errors): the errors (array) of a job's children, in order of their ids; jobs without any are left out."""
    kids = jobs.where("parent_id is not null and size(errors) > 0").groupBy(F.col("parent_id").alias("id"))
    return kids.agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), F.col("errors").alias("e")))).alias("x")).select("id", F.flatten("x.e").alias("errors"))


def attributes_of(attributes: DataFrame, key: str) -> DataFrame:
    """(key, attributes): one map of name to value; of values that share a name the largest. Null names are left out."""
    one = attributes.where("name is not null").groupBy(key, "name").agg(F.max("value").alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))


def listed(jobs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Jobs as lists show them: sizes of request and response, ids of the children, owner, attributes."""
    kids = jobs.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("children"))
    extra = attributes_of(attributes, "job_id").withColumnRenamed("job_id", "id")
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    rows = jobs.join(kids, "id", "left").join(extra, "id", "left")
    return rows.select("id", "status", "owner", size("request").alias("request_size"), size("response").alias("response_size"), F.coalesce("children", F.array().cast("array<long>")).alias("children"), "attributes")


def synchronised(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Attributes (key, name, value) after a sync: those not wanted any more go, new ones come, those there keep their value."""
    keys = [key, "name"]
    kept = current.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(wanted.join(current.select(*keys).distinct(), keys, "left_anti"))


def imported(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after an import: those whose keys come in again are replaced. Null keys replace nothing."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def anticipated(matches: DataFrame, batch: int) -> DataFrame:
    """(movie_url, n_tasks): how many batches of framesets each movie's scan takes."""
    return matches.groupBy("movie_url").agg(F.ceil(F.count_distinct("frameset") / batch).cast("long").alias("n_tasks"))


def node_status(nodes: DataFrame, jobs: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """State of each node (node) of a pipeline: its job's status and percentage, framesets that went in and came out.

    jobs: node, status, percent_complete; inputs, outputs: node and frames. Nodes without a job are not yet created.
    """
    count = lambda df, name: df.select("node", "movie_url", "frameset").distinct().groupBy("node").agg(F.count("*").alias(name))
    rows = nodes.join(jobs, "node", "left").join(count(inputs, "framesets_in"), "node", "left").join(count(outputs, "framesets_out"), "node", "left")
    there = F.col("status").isNotNull()
    n = lambda c: F.when(there, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    percent = F.floor(F.bround("percent_complete", 2) * 100)
    return rows.select("node", F.coalesce("status", F.lit("not yet created")).alias("status"), F.coalesce(percent, F.lit(0)).cast("long").alias("percent"), n("framesets_in"), n("framesets_out"))


def complete_events(jobs: DataFrame, ids: list[str]) -> DataFrame:
    """Jobs that may be told about: those that have all the ids; kind tells if anything was redacted."""
    have = F.lit(True)
    for c in ids:
        have = have & F.col(c).isNotNull()
    return jobs.where(have).withColumn("kind", F.when(F.col("redacted"), "data_redacted").otherwise("no_redaction_data_found"))


def receipts(files: DataFrame) -> DataFrame:
    """Files (status, source_id, new_id) whose new recording is registered: successful ones with both ids."""
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return files.where((F.col("status") == "success") & given("source_id") & given("new_id")).select("source_id", "new_id", F.concat(F.lit("redaction: "), "source_id").alias("source_name"))


def purged(jobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Jobs below the given ones (id) whose folders go, but for those that are bypassed."""
    down = subtree(jobs, roots).where("id <> root").select("id").distinct()
    return jobs.join(down, "id", "left_semi").where(F.coalesce(F.col("status"), F.lit("")) != "bypassed")


#: Short names of kinds of nodes (fixed values); others are '?'.
SHORT = {
    "noop": "N", "template": "T", "selected_area": "SA", "secure_files_import": "IMP", "mesh_match": "MM", "data_sifter": "DS", "focus_finder": "FF", "t1_filter": "T1F", "selection_grower": "SG", "ocr": "OCR",
    "split_and_hash": "S|H", "redact": "R", "zip": "Z", "remove_job_resources": "RM", "save_gt_attribute": "EXP", "t1_sum": "SUM", "t1_dif": "DIF", "pipeline": "P", "intersect": "IN",
}


def described(nodes: DataFrame, scanners: DataFrame) -> DataFrame:
    """Nodes (node, type, entity_id) with short, their kind in short, and task, their kind and their scanner's (or pipeline's) name (id, name)."""
    short = F.lit("?")
    for kind, s in SHORT.items():
        short = F.when(F.col("type") == kind, s).otherwise(short)
    named = F.col("type").isin("template", "selected_area", "mesh_match", "data_sifter", "ocr", "selection_grower", "pipeline") & F.col("name").isNotNull()
    names = scanners.groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"))
    rows = nodes.join(names, "entity_id", "left")
    return rows.select("node", "type", short.alias("short"), F.when(named, F.concat("type", F.lit(" - "), "name")).otherwise(F.col("type")).alias("task"))


def jobs_of_nodes(jobs: DataFrame, attributes: DataFrame, root_of: DataFrame) -> DataFrame:
    """(root, node, id): which job below a root works on a node: the attribute node_id of the job tells; of several the newest.

    root_of: (id, root), as graphs.tops() gives it.
    """
    nodes = attributes.where("name = 'node_id' and value is not null").select(F.col("job_id").alias("id"), F.col("value").alias("node"))
    rows = jobs.select("id", "created_on").join(nodes, "id").join(root_of, "id")
    return rows.groupBy("root", "node").agg(F.max_by("id", F.struct("created_on", "id")).alias("id"))
