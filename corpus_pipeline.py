"""Training-corpus pipeline: five stages over the documents, each written before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattle.llm import decontaminate, lang_id, line_dedup, mixing, ngram_join
from wattle.llm.common import stored, table


def language_id(spark, docs, sf_dir):
    """Documents whose language is clear; the others go."""
    return lang_id.accepted(docs)


def line_deduplication(spark, docs, sf_dir):
    """Texts without lines that an earlier line matches; documents left without words go."""
    return line_dedup.clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones: 0.8 of their five-word shingles, while the
    op6 query has settings of its own."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """The documents that the mix takes, with ``size, source_size, target, taken``."""
    return mixing.mix(docs).where(F.col("taken") > 0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: compression with dictionaries has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
