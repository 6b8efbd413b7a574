"""The corpus operators as registered queries over the tables in a folder, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import audit, decontam, jaccard, katz, langid, media, mixing, pii, secrets, spelling, substrings, toolcalls, toxicity
from veilframe.llm.common import table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the mix takes, with the epochs that take it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.corpus_mix(docs).select("doc_id", "mix_domain", "mix_lang", "mix_source", "n_tokens", "leaf_budget", "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("hit_items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document, by fixed patterns and by the token-efficiency test."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = lambda kinds: F.expr(f"array_join(transform(filter(secrets, x -> x.kind in ({kinds})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    base = "'assign', 'access', 'hex'"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans(base), 256).alias("base_sha256"), spans(base + ", 'random'").alias("spans"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat 100 earlier ones, and a digest of those that stay."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and the group that links to similar documents put it in."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored in a JPEG, read back, with the thumbnail's hash."""
    stored = media.to_media(table(spark, sf_dir, "documents"), keep=["doc_id"])
    read = media.read_media(stored, keep=["doc_id", "n_bytes"])
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "thumb_hash")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call and result in the conversations, linked, ordered, checked and written as canonical JSON."""
    calls, results = toolcalls.from_conversations(table(spark, sf_dir, "conversations"))
    return toolcalls.link_calls(calls, results, toolcalls.SCHEMAS).select("conv_id", "call_id", "seq", "depth", "status", F.array_join("errors", "; ").alias("errors"), "json")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_by_id(docs.where(~held), labels)
    return toxicity.score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of each kind it had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, key=spark.conf.get("spark.veilframe.pii.key", pii.TRIAL_KEY))
    return out.select("doc_id", "text", *[F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS])


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each document under a Katz trigram model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    out = katz.score_texts(docs, ~held, order=3)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at every step of all 120 orders, by language."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the more frequent word that it is a variant of."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learnt from those that aren't held out (documents without an id are)."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    filters = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), filters, keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_decontamination, op3_secrets, op4_substring_dedup, op5_jaccard_join, op6_jpeg_media, op7_tool_calls, op8_toxicity, op9_pii_pseudonyms, op10_katz, op11_filter_audit, op12_spelling_variants, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": mixing.oracle(), "op2_decontamination": decontam.ORACLE, "op11_filter_audit": audit.ORACLE}
