"""Registered queries of the operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plotstats.plans.session import scratch_path

from . import (byte_repeats, decontamination, language_id, merkle_manifest, ngram_join, periodic_runs, pii, quality_model, quality_rules,
               sampled_pieces, secret_scan, token_files, warc)
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    back = sampled_pieces.decode(sampled_pieces.encode(docs, model, keep_text=False), model)
    decoded = F.sha2("decoded", 256)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), decoded.alias("decoded_sha256"),
                       decoded.eqNullSafe(F.col("text_sha256")).alias("lossless"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, compression="gzip")
    return warc.page_records(warc.read_warc(spark, path, payload=False))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.find_pii(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), 3, 9, 10).select("doc_id", "n_shingles", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.token_index(spark, path).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")


def op11_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle_manifest.without_newlines(F.col("doc_id"), F.col("text"))
    found = merkle_manifest.manifest(merkle_manifest.document_leaves(docs, tampered))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), reorder=periodic_runs.planted_period)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sampled_pieces, op2_language_id, op3_quality_model, op4_warc, op5_pii, op6_decontamination, op7_secret_scan, op8_ngram_join, op9_quality_rules, op10_token_files,
    op11_byte_repeats, op12_merkle_manifest, op13_periodic_runs)}
