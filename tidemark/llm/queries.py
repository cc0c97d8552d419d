"""The query of each operator: production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, factorisation, html_extract, langid, merkle, packing, pii, quality, sharding, simhash, substring, warc, wavelet
from tidemark.llm._shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1
    model = langid.train(docs.where(~held))
    # A missing id has no checksum: such rows neither teach nor are held out.
    return langid.predict(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_removed", F.col("clean_text").alias("text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held)
    machine = factorisation.train(docs, labels, metadata=("n_chars",))
    return factorisation.score(docs.withColumn("held_out", held), machine, metadata=("n_chars",)).select("doc_id", "held_out", "score", "predicted")


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    # What the tampered rows would have for a leaf; null where a row is left as it is.
    other = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0, merkle.leaf("doc_id", "source", "lang", F.try_add("n_chars", F.lit(1)), "text"))
    found = merkle.manifest(docs, list(LEAF), "lang", "doc_id", {"tampered": other})
    proven = merkle.proven(found.withColumn("now", F.coalesce("tampered", "leaf")), "now")
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.search(wavelet.index(docs), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_html_extraction, op4_pii, op5_sharding, op6_packing, op7_language_id, op8_simhash, op9_substring_dedup, op10_quality_rules, op11_quality_classifier, op12_merkle_manifest, op13_ranked_search)}
