"""Registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, lang_id, licenses, line_dedup, mixing, ngram_join, prefix_trie, quality, secrets, sharding, source_audit,
               token_count, url_filter)
from .common import columns, table


def op1_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return d.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def document_paths(docs):
    """Documents as files: a tree of source, ten thousand and hundred ids, with files at
    every level."""
    d = columns(docs, "doc_id", "text", "source")
    i, top = F.col("doc_id"), F.coalesce("source", F.lit("unknown"))
    block, sub = F.expr("doc_id div 10000"), F.expr("doc_id div 100")
    path = (F.when(i % 10000 < 100, F.concat_ws("/", top, i)).when(i % 100 < 10, F.concat_ws("/", top, block, i))
            .otherwise(F.concat_ws("/", top, block, sub, i)))
    return d.select("doc_id", "text", path.alias("path"))


def op2_license_scan(spark, sf_dir):
    files = document_paths(table(spark, sf_dir, "documents"))
    d = licenses.scan(files, licence_file=F.lit(False), declares=F.lit(True))
    return d.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "licence", "how",
                    F.round("score", 6).alias("score"), "from_dir")


def op3_source_mix(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = lang_id.held_out(F.col("doc_id"))
    model = lang_id.learn(columns(docs, "doc_id", "text", "lang").where(~held))
    return lang_id.identify(docs, model).withColumn("held_out", held)


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    d = quality.score(table(spark, sf_dir, "documents"))
    return d.withColumn("js_char", F.round("js_char", 6)).withColumn("js_word", F.round("js_word", 6))


def op8_url_filters(spark, sf_dir):
    pages = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op9_secret_scan(spark, sf_dir):
    d = secrets.scan(table(spark, sf_dir, "documents"))
    count = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return d.select("doc_id", *count, F.sha2(secrets.joined("assign", "access", "hex"), 256).alias("base_sha256"),
                    secrets.joined(*secrets.KINDS).alias("spans"))


def op10_decontamination(spark, sf_dir):
    d = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op12_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_sharding(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_source_mix": op3_source_mix,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_audit": op12_source_audit,
    "op13_sharding": op13_sharding,
}
