"""The operators over their whole tables, with the columns their contracts name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwave.llm import audit, chat, decontaminate, gramjoin, infill, neardup, neighbours, packing, pii, quality, secrets, sql, toxicity, warc
from cartwave.llm.common import held_out, span_list, table
from cartwave.registry.base import Registry


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), packing.public_coder())


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secrets.found().alias("spans"))
    base = docs.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS)))
    counts = [_count("base", k) for k in secrets.KINDS]
    return base.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, items).drop("text_hash", "coverage")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", held_out().alias("held_out"), toxicity.score(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.formatted(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = docs.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS)))
    counts = [_count("base", k) for k in pii.KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores")
    return base.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), scores)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", held_out().alias("held_out"), quality.score(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gramjoin.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    return docs.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restored(output, form), 256).alias("restored_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def register(found: Registry) -> None:
    found.add("op1_best_fit_packing", op1_best_fit_packing)
    found.add("op2_secret_scans", op2_secret_scans)
    found.add("op3_benchmark_decontamination", op3_benchmark_decontamination, sql.OP3)
    found.add("op4_warc", op4_warc, sql.OP4)
    found.add("op5_toxicity", op5_toxicity)
    found.add("op6_chat_formatting", op6_chat_formatting, sql.OP6)
    found.add("op7_pii", op7_pii)
    found.add("op8_quality_classifier", op8_quality_classifier)
    found.add("op9_nearest_neighbours", op9_nearest_neighbours)
    found.add("op10_minhash_near_dedup", op10_minhash_near_dedup)
    found.add("op11_ngram_jaccard_join", op11_ngram_jaccard_join)
    found.add("op12_fill_in_middle", op12_fill_in_middle, sql.OP12)
    found.add("op13_filter_audit", op13_filter_audit, sql.OP13)
