"""The corpus pipeline: from raw documents to tokens, a stage at a time.

Each stage works on all that its predecessor kept, as a table; ``run`` writes every stage's rows to the shared folder
and reads them back, so a lost executor costs a stage's tasks and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, decontaminate, neardup, pii, quality
from skyloom.llm.common import load, stage, unstage
from skyloom.llm.queries import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as empty ones, repeated rows alike."""
    return quality.accepted(docs, load(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Of rows of one id one stays; rows without
    an id all stay, and texts without words, null ones too, are groups of their own."""
    return neardup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; an empty benchmark keeps all."""
    return decontaminate.cleaned(docs, load(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with identifiers in their texts replaced by their kinds. A null text becomes an empty one."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, a row for each row; null and empty texts have no tokens."""
    return bpe.encode(docs, vocabulary_path())


STAGES = [("quality", keep_good), ("near-duplicates", keep_first_copies), ("benchmark leaks", drop_leaks), ("personal data", redact), ("tokens", encode)]

#: Learned scores, MinHash components and merges have no SQL form; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. A stage's table is deleted once the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
