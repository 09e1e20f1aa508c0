"""Token ids as ORC files: integer run lengths, row indexes, Bloom filters on the document id.

Documents are dealt out by ranges of their id and encoded after they have moved, so texts move once and the files, in the order of their names, hold the
documents in ascending order. ORC writes the ids as run-length coded integers in stripes of a stated size; every row group of a stripe has its bounds and a Bloom
filter of document ids. A reader of all takes stripes in parallel; a reader of some ids passes over stripes and row groups that can't have them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from ._tokens import byte_level_encoder

#: Bytes of a stripe, rows of a row group, and the share of absent ids that a Bloom filter takes for present.
STRIPE_BYTES, ROW_GROUP, FALSE_POSITIVES = 16 << 20, 1000, 0.01
#: A writer looks at the size of its stripe after so many rows: few, as a row can be long.
CHECKED_ROWS = 64


def _lists(parts: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of several documents as one Arrow list array."""
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def _encoder(tokenizer_path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches):
        all_ids, part, start = byte_level_encoder(tokenizer_path).all_ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = _lists([ids + end for ids in all_ids([t or "" for t in batch.column("text").to_pylist()])])
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "n_tokens", "ids"])

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, *, files: int | None = None, stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text), then ``end_id``, to ``files`` ORC files at ``path``, in ascending order of doc_id.

    Null ids come first; rows of one id follow by a digest of their texts, and such rows, repeated or without an id, may spread over several files, however many they
    are. A null text counts as empty: it has the end id alone. An empty table writes files without rows. Other columns are left out.

    A row has doc_id, part (the file's number), place (ids before it in its file), n_tokens and ids.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    # the row number only parts rows that are equal in id and text, and so may change places
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_n"]
    dealt = keyed.repartitionByRange(files or C.partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = dealt.mapInArrow(_encoder(tokenizer_path, end_id), f"doc_id {kind}, part int, place long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.create.index": "true", "orc.row.index.stride": row_group, "orc.stripe.size": stripe_bytes, "orc.rows.between.memory.checks": CHECKED_ROWS, "compression": "zstd"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files at ``path``: of all documents, or of those whose id is in the short list ``doc_ids``.

    ``start`` counts the ids of all documents before. It comes from the sum of each file, one row per file, for which only two columns are read.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    wanted = rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))
    placed = wanted.join(F.broadcast(totals.select("part", before.alias("_before"))), "part")
    return placed.select("doc_id", (F.col("place") + F.col("_before")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        lists = batch.column("ids")
        ids, at = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` returns, counted and summed from the ids themselves."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all documents, read from the ORC files that they were written to."""
    import public_tokenizers

    path = C.new_path(spark, "token-ids")
    write_tokens(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(read_tokens(spark, path))
