"""The corpus pipeline: stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.llm import decontam, jaccard, mixing, pii, toxicity
from veilframe.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs, sf_dir):
    """Learn from all labelled documents, score every document, keep those below 0.5 (ids without a text too)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_by_id(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model, out="toxic_score").where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of similar documents one row stays: the smallest id, null ids last; of rows that share it the one
    with the smallest digest, of equal rows any. Documents without words are in no group and stay."""
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64(*COLUMNS).alias("digest"), "row").alias("rank")
    docs = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    groups = jaccard.similar_documents(docs, id_col="row").select("row", "component_id")
    first = docs.select("row", row).join(groups, "row").groupBy("component_id").agg(F.min("rank").alias("first"))
    return docs.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def drop_benchmark(spark, docs, sf_dir):
    """Documents with any word in a benchmark window go."""
    found = decontam.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*COLUMNS)


def replace_personal_data(spark, docs, sf_dir):
    """Personal data in every text gets pseudonyms; n_chars follows the new text."""
    key = spark.conf.get("spark.veilframe.pii.key", pii.TRIAL_KEY)
    return pii.pseudonymise(docs.select(*COLUMNS), key=key).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """The documents that the mix takes, with the epochs that take them."""
    return mixing.corpus_mix(docs.select(*COLUMNS))


STAGES: list = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]
#: The classifier and the text operators can't be told in SQL. tests/llm holds the operators against plain versions, the
#: stages and run() against plain rules on a small corpus (test_pipeline.py).
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
