"""From raw documents to packed training sequences: the stages, in order, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybridge.llm import _common as C
from tallybridge.llm import language_id, mixing, packing, simhash


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go (no letters, or a calibrated score below its threshold)."""
    model = language_id.fit(docs, F.lit(True))
    added = ["lang_pred", "score", "rejected"]
    clashing = {c: f"_in_{c}" for c in docs.columns if c in added}
    judged = language_id.identify(docs.withColumnsRenamed(clashing), model).where(~F.col("rejected")).drop(*added)
    return judged.withColumnsRenamed({v: k for k, v in clashing.items()}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, over shingles of five words at a similarity of 0.8: the one with the smallest doc_id.

    Of rows with one id but different texts each belongs to its own text's group, so several can stay. Repeated rows of an id and text leave one row; a
    document with a null id stays where its group has no document with an id, and then one of them does.
    """
    chosen = simhash.one_of_each(docs, size=5, similarity=0.8).select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_chosen"))
    told = docs.withColumn("_digest", simhash.text_digest())
    kept = told.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_chosen")), "left_semi").dropDuplicates(["doc_id", "_digest"])
    return kept.select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The temperature mixture of sources: every document at least once, those of small sources again in later epochs."""
    return mixing.mix(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json")).select(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in packed sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", to_target_weights),
    ("best-fit packing", into_sequences),
]
#: Language identification trains a model; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and reread."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
