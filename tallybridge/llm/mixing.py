"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's share of all tokens is raised to an exponent between 0 (all sources equal) and 1 (as they are). Bisection finds the largest
exponent whose weights reach a target entropy, and the smallest that keeps every source under a repetition limit; the limit wins. The
weights become token budgets. Every epoch of a source is a pseudo-random permutation of its rows; its epochs one after the other are cut at its budget and into
blocks, so that each block holds the same part of every source's budget, but for the document at its edge. The default budget is the least at which no source
falls below one epoch, so no document is lost.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from ._tokens import lower_word_counter

#: Entropy to reach as a share of that of equal weights, and how often a document may come at most.
ENTROPY, REPEATS = 0.97, 2.0
#: Tokens in a block of the mixture, and rows of a hash slice of an epoch of a source on average at most, within which places are summed up row by row.
BLOCK_TOKENS, SLICE_ROWS = 1 << 20, 1 << 14


def weights(tokens: dict, alpha: float) -> dict:
    """Normalised shares to the power alpha; a source without tokens weighs nothing."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** alpha if n else 0.0 for s, n in tokens.items()}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()} if norm else raised


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repetition(tokens: dict, w: dict) -> float:
    """Epochs of the most repeated source when the least repeated one comes once."""
    total = sum(tokens.values())
    epochs = [w[s] * total / n for s, n in tokens.items() if n]
    return max(epochs) / min(epochs) if epochs else 1.0


def exponent(tokens: dict, target: float = ENTROPY, limit: float = REPEATS) -> float:
    """Bisect the exponent. Entropy falls and repetition falls as it grows from 0 to 1, so both conditions are bounds on it."""
    live = {s: n for s, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0

    def bisect(holds) -> float:
        low, high = 0.0, 1.0  # holds(low), not holds(high)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    goal = target * math.log(len(live))
    enough = lambda a: entropy(weights(live, a)) >= goal
    alpha = 1.0 if enough(1.0) else bisect(enough)
    too_many = lambda a: repetition(live, weights(live, a)) > limit
    if too_many(alpha):
        low, high = alpha, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if too_many(mid) else (low, mid)
        alpha = high
    return alpha


def budgets(tokens: dict, w: dict, budget: int | None = None) -> dict:
    """Tokens for each source: its weight of ``budget``, or of the least budget that gives every source one epoch."""
    live = {s: n for s, n in tokens.items() if n and w[s]}
    total = budget if budget is not None else max((n / w[s] for s, n in live.items()), default=0)
    return {s: max(w[s] * total, n if budget is None else 0) for s, n in live.items()}


def token_length(text: Column) -> Column:
    """Words between white space, and single characters of scripts without spaces: a measure without a tokenizer, and 1 at least."""
    pieces = f"[{C.UNSPACED}]|[^{C.SPACE}{C.UNSPACED}]+"
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pieces)), F.lit(1)).cast("long")


def _counter(tokenizer_path: str, text: str, name: str):
    def count(batches):
        tokens = lower_word_counter(tokenizer_path).count
        for batch in batches:
            n = [tokens(t or "") + 1 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, name])

    return count


def with_tokens(docs: DataFrame, name: str, text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``docs`` and ``name``: tokens of each text and the one that ends it, by the lower-casing word tokenizer; without one, by ``token_length``."""
    if tokenizer_path is None:
        return docs.withColumn(name, token_length(F.col(text)))
    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(_counter(tokenizer_path, text, name), T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer_path: str | None = None, without: tuple[str, ...] = (),
    target: float = ENTROPY, limit: float = REPEATS, budget: int | None = None, seed: int = 5, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Rows of ``docs``, repeated by epoch, with n_tokens, weight, epoch (from 0), block and place (a pseudo-random order within the block).

    A null source is a source of its own. A source's rows come epoch after epoch, each in an order of its own, until its budget is reached; the row that reaches
    it is the last. A row's place in that sequence, in tokens, tells its block. Places are sums over hash slices of an epoch first and over the rows of
    a slice second, so neither a source nor the repeats of one row are ever gathered; the number of slices follows from that of rows. The order depends on where
    rows are read, so a table split otherwise is mixed otherwise. Null ids and texts and repeated rows count like others. An empty table gives no rows. Other columns pass through but for those of ``without``; those with the names of results are replaced. One number per source is gathered.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "weight", "epoch", "block", "place")
    given = [c for c in docs.columns if c not in without]
    counts, hashed, of, turn, part, before, run, share, epochs, known = C.free_names(docs, "_n", "_hash", "_source", "_turn", "_slice", "_before", "_run", "_budget", "_epochs", "_of")
    rows = with_tokens(docs, counts, text, tokenizer_path)
    # rows are told apart by where they were read as well, or repeats of one row would all be neighbours and share a slice; written before use, so it stays
    own = F.xxhash64(doc_id, text, F.lit(seed), F.monotonically_increasing_id())
    named = F.concat(F.when(F.col(source).isNull(), F.lit("")).otherwise(F.lit("=")), F.coalesce(F.col(source).cast("string"), F.lit("")))
    rows = C.materialize(rows.select(*given, counts, own.alias(hashed), named.alias(of)), "counted")
    totals = rows.groupBy(of).agg(F.sum(counts).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    tokens = {r[of]: r["n"] for r in totals}
    n_slices = max(C.partitions(spark), -(-max((r["rows"] for r in totals), default=0) // SLICE_ROWS))
    w = weights(tokens, exponent(tokens, target, limit)) if tokens else {}
    wanted = budgets(tokens, w, budget)
    plan = [(s, float(w[s]), float(n), max(1, math.ceil(n / tokens[s] - 1e-9))) for s, n in wanted.items() if n > 0]
    table = spark.createDataFrame(plan, f"`{known}` string, weight double, `{share}` double, `{epochs}` int")
    rows = rows.join(F.broadcast(table), F.col(of) == F.col(known)).drop(known)  # one row per source, as counted above
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col(epochs) - 1))).drop(epochs)
    rows = rows.withColumn(turn, F.xxhash64(hashed, "epoch", F.lit(seed + 1))).withColumn(part, F.pmod(turn, F.lit(n_slices)).cast("int"))
    key = [of, "epoch", part]
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy("epoch", part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = rows.groupBy(*key, share).agg(F.sum(counts).alias("n")).withColumn(before, earlier)
    slices = C.materialize(slices.where(F.col(before) < F.col(share)).select(*key, before), "slices")
    dealt = rows.join(slices, key)
    sums = F.sum(counts).over(Window.partitionBy(*key).orderBy(turn, doc_id).rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn(run, F.col(before) + F.coalesce(sums, F.lit(0))).where(F.col(run) < F.col(share))
    n_blocks = max(1, math.ceil(sum(wanted.values()) / block_tokens))
    block = F.least(F.floor(F.col(run) / F.col(share) * n_blocks), F.lit(n_blocks - 1)).cast("long")
    return dealt.select(*given, F.col(counts).alias("n_tokens"), "weight", "epoch", block.alias("block"), F.xxhash64(turn, of, run).alias("place"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source, counted in tokens of the tokenizer that packs them."""
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), without=("text",))
