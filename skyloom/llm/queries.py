"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, conversations, decontaminate, licenses, neardup, passages, pii, quality, rules, secrets, simhash, toxicity
from .common import load

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files keep one of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a verdict for each document; null and empty texts are scored as empty ones."""
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data for each document; null and empty texts have none."""
    return pii.find(load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, votes and the verdict for each document; without words all figures are 0 and the text fails."""
    return rules.judge(load(spark, sf_dir, "documents"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests for each document; null and empty texts have no tokens."""
    return bpe.encode(load(spark, sf_dir, "documents"), vocabulary_path())


def op5_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document; texts without words are linked with nothing."""
    return neardup.classes(load(spark, sf_dir, "documents"))


def op6_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets for each document; null and empty texts have none."""
    return secrets.find(load(spark, sf_dir, "documents"))


def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of each document; null and empty texts have ''."""
    return licenses.scan(load(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the spans that stood in an earlier one; null and empty texts stay empty."""
    return passages.deduplicate(load(spark, sf_dir, "documents"))


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a verdict for each document; null and empty texts get the bias."""
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages that each document holds; null and empty texts hold none."""
    return decontaminate.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of each document; null and empty texts have fingerprint zero."""
    return simhash.classes(load(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and a digest of it for each conversation; nulls count as one space."""
    return conversations.report(load(spark, sf_dir, "conversations"))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and error of each sound vector; others are dropped."""
    return codes.report(load(spark, sf_dir, "embeddings"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kf: int(kf[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_odd_sketch": neardup.oracle_sql(), "op6_multipart_secrets": secrets.oracle_sql(), "op7_license_dice": licenses.oracle_sql(), "op12_conversation_repair": conversations.oracle_sql(), "op13_filtering_lloyd": codes.oracle_sql()}
