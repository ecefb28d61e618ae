"""The registered queries of the operators: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm import oracle
from gridscope.llm.chat import conversation_digest, prefix_target_examples
from gridscope.llm.common import fold_of, load
from gridscope.llm.direct_codes import token_file_digest
from gridscope.llm.importance import importance_draw
from gridscope.llm.infilling import infilling_examples, with_restored
from gridscope.llm.licences import licence_digest, licence_spans
from gridscope.llm.mixing import mix
from gridscope.llm.outliers import outlier_verdicts
from gridscope.llm.packing import packed
from gridscope.llm.ppm import language_scores
from gridscope.llm.simhash import near_duplicates
from gridscope.llm.syncmers import edited_fingerprints
from gridscope.llm.toxicity import HELD_OUT_FOLD, toxic_documents
from gridscope.llm.trie_counts import unigram_token_counts


def op1_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return outlier_verdicts(load(spark, folder, "documents")).drop("row_key", "n_lines")


def op2_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one full of control strings, as prefix-target examples."""
    talks = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said
    )
    return conversation_digest(prefix_target_examples(talks.unionByName(more)))


def op3_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Syncmer fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(load(spark, folder, "documents"))


def op4_trie_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    return unigram_token_counts(load(spark, folder, "documents"))


def op5_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_file_digest(load(spark, folder, "documents"))


def op6_nearest_toxic(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, with the five nearest labelled ones."""
    scored = toxic_documents(load(spark, folder, "documents"), load(spark, folder, "labels"))
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.slice("toxicity.evidence.doc_id", 1, 5).alias("nearest"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(load(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """PPM and unigram scores of every document."""
    return language_scores(load(spark, folder, "documents"))


def op9_sainte_lague(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(load(spark, folder, "documents")).drop("segments")


def op10_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed(load(spark, folder, "documents"))


def op11_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return licence_digest(licence_spans(load(spark, folder, "documents")))


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    """All documents weighed towards the benchmark, and the drawn ones ranked."""
    found = importance_draw(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_infilling(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-middle examples of all documents, and the texts rebuilt from them."""
    found = with_restored(infilling_examples(load(spark, folder, "documents")))
    digests = (F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


REGISTRY = {
    "op1_robust_outliers": (op1_robust_outliers, None),
    "op2_prefix_targets": (op2_prefix_targets, oracle.PREFIX_TARGETS),
    "op3_syncmers": (op3_syncmers, None),
    "op4_trie_counts": (op4_trie_counts, None),
    "op5_direct_codes": (op5_direct_codes, None),
    "op6_nearest_toxic": (op6_nearest_toxic, None),
    "op7_simhash": (op7_simhash, None),
    "op8_ppm": (op8_ppm, None),
    "op9_sainte_lague": (op9_sainte_lague, None),
    "op10_vector_packing": (op10_vector_packing, None),
    "op11_licences": (op11_licences, None),
    "op12_importance": (op12_importance, oracle.IMPORTANCE),
    "op13_infilling": (op13_infilling, oracle.INFILLING),
}
