"""A corpus pipeline over documents: each stage calls one operator and reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.llm import decontaminate, linededup, quality, sentencepiece_bridge, simhash
from tideline.llm.common import materialise, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark, docs, sf_dir):
    """Lines that match an earlier line go from the texts; n_chars follows. Documents stay, if without text."""
    kept = linededup.dedup_lines(docs)
    return kept.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark, docs, sf_dir):
    """Token ids of each document, with whether they decode to its text."""
    model = sentencepiece_bridge.model_bytes(spark, sentencepiece_bridge.default_model())
    return sentencepiece_bridge.encode(docs, model)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: No SQL: a learned classifier, a tokenizer and fingerprints are not expressible; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of documents that all stages keep, with token ids. Each stage defines what it does with nulls, empty and
    very long texts, ties, repeated rows and clashing columns (see its operator); an empty table gives an empty result.
    All stages but the last are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
