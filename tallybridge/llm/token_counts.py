"""Token counts with a digest cache.

The SHA-256 of a text (null taken as empty; anything more would change counts) and of the tokenizer file are its key in a table of counts. Texts whose key is
not there yet are encoded once for each distinct text, whatever the number of copies, and their counts are appended; then every row looks its count up.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import byte_level_counter

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(tokenizer_path: str) -> str:
    return hashlib.sha256(Path(tokenizer_path).read_bytes()).hexdigest()


def _encoder(tokenizer_path: str, version: str):
    def encode(batches):
        count = byte_level_counter(tokenizer_path).count
        for batch in batches:
            counts = [count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return encode


#: What becomes of the rows of one digest and id: encoded where they are, brought together first as there are several, or left alone.
_HERE, _TOGETHER, _NOT = 0, 1, 2


def _roles(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, id, role): of the ids of a digest that is not known the smallest is encoded; no texts are moved."""
    keys = C.materialize(rows.groupBy("digest", "id").agg(F.count("*").alias("n")), "digests")
    misses = keys.groupBy("digest").agg(F.min("id").alias("least")).join(known, "digest", "left_anti").withColumn("missing", F.lit(True))
    chosen = F.coalesce("missing", F.lit(False)) & F.col("id").eqNullSafe(F.col("least"))
    told = keys.join(misses, "digest", "left").select("digest", "id", F.when(~chosen, _NOT).when(F.col("n") > 1, _TOGETHER).otherwise(_HERE).alias("role"))
    return C.materialize(told, "roles")


def _distinct_misses(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """(digest, text) once for every digest that is to be encoded.

    Texts meet the shorter list, of rows to encode or of rows to leave alone, both without texts; where Spark finds it small enough to broadcast, no text moves.
    Only repeated rows of one digest and id, which ids can't tell apart, are grouped by digest; copies are merged before they move.
    """
    size = {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()}
    same = lambda r: (texts["digest"] == r["digest"]) & texts["id"].eqNullSafe(r["id"])
    here, others = roles.where(F.col("role") == _HERE), roles.where(F.col("role") != _HERE)
    few = size.get(_HERE, 0) <= size.get(_TOGETHER, 0) + size.get(_NOT, 0)
    out = (texts.join(here, same(here), "left_semi") if few else texts.join(others, same(others), "left_anti")).select("digest", "text")
    if size.get(_TOGETHER):
        several = roles.where(F.col("role") == _TOGETHER)
        out = out.union(texts.join(several, same(several), "left_semi").groupBy("digest").agg(F.first("text")))
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``digest`` and ``n_tokens``; counts that were missing are appended to the parquet table at ``cache_path``.

    A null text counts as empty (0 tokens). Equal texts are encoded once, repeated rows of an id and rows with a null id among them, and all keep their rows. An
    empty input appends nothing. Other columns pass through; a column of the input that is called ``digest`` or ``n_tokens`` is replaced.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    docs = docs.drop("digest", "n_tokens").withColumn("digest", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest")
    texts = docs.select("digest", F.col(doc_id).alias("id"), F.col(text).alias("text"))
    encoded = _distinct_misses(texts, _roles(texts.select("digest", "id"), known)).mapInArrow(_encoder(tokenizer_path, version), CACHE_SCHEMA)
    encoded.write.mode("append").parquet(cache_path)
    # two runs that share a cache can both append a digest, with one count
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that the join has nothing but two exchanges below it and AQE can split the rows of a frequent digest
    return docs.join(C.materialize(counts, "counts"), "digest")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by the byte-level tokenizer, through a new cache in the shared folder."""
    import public_tokenizers

    # the length is taken before the join, so that no text travels with it
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), C.new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
