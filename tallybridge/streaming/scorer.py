"""Scoring a stream of statement rows against a ledger at rest. One-to-one assignment needs the whole statement and stays a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import cleaning
from ..operators import scoring
from ..operators.shared import written
from ..operators.shortlist import shortlists


def best_of_batch(rows: DataFrame, ledger: DataFrame, rows_name: str, ledger_name: str, *, key: str = "b_idx", algorithm: str = "weighted", thresholds: scoring.Thresholds = scoring.Thresholds()) -> DataFrame:
    """(key, a_clean, score, tier): the best ledger name of every row, by the scores of the batch plan; the first name of equals, score 0 and no name for a row
    that nothing is like."""
    pairs = scoring.score_names(scoring.names(ledger, ledger_name, "a"), scoring.names(rows, rows_name, "b"), algorithm).where(F.col("score") > 0)
    best = pairs.groupBy("b_clean").agg(F.min_by(F.struct("a_clean", "score"), F.struct((-F.col("score")).alias("o"), "a_clean")).alias("best"))
    told = rows.select(key, cleaning.clean_name(F.col(rows_name).cast("string")).alias("b_clean")).join(best, "b_clean", "left")
    score = F.coalesce("best.score", F.lit(0.0))
    return told.select(key, F.col("best.a_clean").alias("a_clean"), score.alias("score"), thresholds.tier(score).alias("tier"))


def best_for_stream(stream: DataFrame, ledger: DataFrame, stream_name: str, ledger_name: str, write: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that scores every micro-batch as a batch of its own and hands the result to ``write``; nothing is kept between batches. Start it as any other.

    ``options`` are those of ``best_of_batch``. A repeated micro-batch has the same number, so an idempotent ``write`` makes results exactly once.
    """
    return stream.writeStream.foreachBatch(lambda rows, number: write(best_of_batch(rows, ledger, stream_name, ledger_name, **options), number))


def _state(folder: str, number: int) -> str:
    return f"{folder}/state/{number:012d}"


def finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose table is whole."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/*/_SUCCESS")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(root) or [])


def best_so_far(spark: SparkSession, folder: str) -> DataFrame | None:
    """(a_first, b_idx, points) after the last finished batch of ``keep_best``: the best statement row so far of every ledger name; None before the first."""
    done = finished(spark, folder)
    return spark.read.parquet(_state(folder, done[-1])) if done else None


def keep_best(stream: DataFrame, ledger: DataFrame, stream_name: str, ledger_name: str, folder: str, *, key: str = "b_idx", ledger_key: str = "a_idx", algorithm: str = "weighted") -> DataStreamWriter:
    """A writer that keeps the best row so far of every ledger name, named by the smallest key of its records; ``best_so_far`` reads it.

    Each micro-batch is scored as a batch and merged with the table of the one before, by score and then the smallest key, so the result is that of one batch
    over all rows. A batch writes a table of its own, of a row per ledger name, and reads its predecessor's, which stays until it is done: a batch that is run
    again after a failure or a restart writes the same rows, so each row of the stream counts once. A name that nothing is like has the smallest key at 0
    points. Null and empty names are like nothing. A stream without rows leaves no rows. The stream's checkpoint is in ``folder`` as well.
    """
    spark = ledger.sparkSession
    own = written(scoring.names(ledger, ledger_name, "a", ledger_key), "ledger-names")

    def merge(rows: DataFrame, number: int) -> None:
        rows = rows.select(F.col(stream_name), F.col(key)).persist()
        lists = shortlists(scoring.score_names(own, scoring.names(rows, stream_name, "b", key), algorithm), 1)[0]
        least = rows.agg(F.min(key).alias("_least"))  # one row
        told = own.select("a_first").join(lists, "a_first", "left").crossJoin(least)
        told = told.select("a_first", F.coalesce("b_first", "_least").alias("b_idx"), F.coalesce("points", F.lit(0)).cast("long").alias("points")).where(F.col("b_idx").isNotNull())
        if number:
            told = told.unionByName(spark.read.parquet(_state(folder, number - 1)))
        best = told.groupBy("a_first").agg(F.min_by(F.struct("b_idx", "points"), F.struct((-F.col("points")).alias("o"), "b_idx")).alias("best"))
        best.select("a_first", "best.*").write.mode("overwrite").parquet(_state(folder, number))
        rows.unpersist()
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_state(folder, number - 2))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint")
