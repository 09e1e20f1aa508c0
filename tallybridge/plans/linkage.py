"""The whole linkage run: names scored once into short lists, assignment from them, result tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators import assign as S
from ..operators import results as R
from ..operators.scoring import Thresholds, names, observed, score_names
from ..operators.shared import written
from ..operators.shortlist import LENGTH, all_names, shortlists
from .progress import Marks

A_NAME, B_NAME, AMOUNT, DAY = "客户名称", "对方户名", "交易金额（元）", "交易日期"


class LinkageError(Exception):
    """Input that cannot be linked: a missing file, sheet or name column."""


@dataclass
class Linkage:
    """Results of a run; everything but scoring and assignment is evaluated when it is read. ``lists`` are the short lists of candidates of names."""

    a: DataFrame
    b: DataFrame
    lists: DataFrame
    done: DataFrame
    matches: DataFrame
    a_only: DataFrame
    b_only: DataFrame
    summary: DataFrame
    statistics: DataFrame
    claims: DataFrame
    thresholds: Thresholds

    def sheets(self) -> dict[str, DataFrame]:
        return {"模糊匹配结果": self.matches, "A系统独有": self.a_only, "B系统独有": self.b_only, "匹配统计汇总": self.summary}


def indexed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Rows with a number from 0 by their order of reading where ``key`` is not there yet."""
    if name not in df.columns:
        raise LinkageError(f"no column {name!r}; there are {', '.join(df.columns)}")
    if key in df.columns:
        return df
    at = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    offsets = counts.select("_part", before.alias("_before"))
    return at.join(F.broadcast(offsets), "_part").withColumn(key, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_at", "_part", "_before")


def link(a: DataFrame, b: DataFrame, *, a_name: str = A_NAME, b_name: str = B_NAME, thresholds: Thresholds = Thresholds(), algorithm: str = "weighted", blocking: str | None = None, tie_break: bool = True, prune_below_floor: bool = False, penalty_from: float = 0.0, progress: Callable[[int, str], None] | None = None, log: Callable[[str], None] | None = None) -> Linkage:
    """Clean, score, rule, assign one to one, and lay out the result tables.

    ``progress`` is told the per cent done and the step, while pairs are scored by the share of tasks done, ``log`` the counts of what was done. Counts are observed in the passes
    that are made anyway; neither adds a job.

    Null and empty names match nothing. An empty side leaves every row of the other on its own. Missing optional columns become empty text or 0; a missing
    name column is an error. Every ledger row has a result: one that nothing is like has the first statement row as its best, at score 0. Ledger rows whose best
    score reaches the floor are served in turn, the best score first; each takes its best free row, or the first free one at score 0 where it is like none of those left, and so
    occupies it. ``prune_below_floor`` gives rows only what reaches the floor. ``penalty_from`` is the base score from which the core penalty counts (``score_names``).
    """
    tell = Marks(progress)
    tell(0, "clean")
    spark = a.sparkSession
    a, b = indexed(a, a_name, "a_idx"), indexed(b, b_name, "b_idx")
    amounts = tie_break and AMOUNT in a.columns and AMOUNT in b.columns
    days = amounts and DAY in a.columns and DAY in b.columns
    seen = {"a": Observation(), "b": Observation(), "pairs": Observation(), "done": Observation()}

    def records(df: DataFrame, name: str, side: str, number: str) -> DataFrame:
        raw, clean = F.col(name).cast("string"), cleaning.clean_name(F.col(name).cast("string"))
        x = F.col(AMOUNT).try_cast("double") if amounts else F.lit(None).cast("double")
        day = F.col(DAY).cast("string") if days else F.lit(None).cast("string")
        out = df.select(f"{side}_idx", clean.alias("clean"), x.alias(number), day.alias(f"{side}_day"), (~raw.eqNullSafe(clean)).alias("_changed"))
        return written(out.observe(seen[side], F.count(F.lit(1)).alias("rows"), F.count_if("_changed").alias("changed")).drop("_changed"), "records")

    own, rows = records(a, a_name, "a", "x"), records(b, b_name, "b", "y")
    n_a, n_b = seen["a"].get["rows"], seen["b"].get["rows"]
    tell(3, "names")
    a_names, b_names = (written(names(df, "clean", side, f"{side}_idx"), "names") for df, side in ((own, "a"), (rows, "b")))
    tell(6, "names")
    own = written(own.join(a_names.select(F.col("a_clean").alias("clean"), "a_first"), "clean").drop("clean"), "records")
    rows = written(rows.join(b_names.select(F.col("b_clean").alias("clean"), "b_first"), "clean").drop("clean"), "records")
    tell(10, "score")

    def listed(left: DataFrame, right: DataFrame, k: int, observe: bool = False) -> tuple[DataFrame, DataFrame]:
        counts = seen["pairs"] if observe else None
        if blocking is None:
            lists, best_b = all_names(left, right, k, algorithm=algorithm, penalty_from=penalty_from, seen=counts)
        else:
            lists, best_b = shortlists(observed(score_names(left, right, algorithm, blocking, penalty_from), counts), k)
        if prune_below_floor:
            least = thresholds.floor * 10000
            lists = lists.where(F.col("points") >= least).withColumn("cut", F.when(F.col("cut") < least, 0).otherwise(F.col("cut")))
        return lists, best_b

    def longer(names_a: DataFrame, k: int, names_b: DataFrame | None) -> DataFrame:
        return listed(a_names.join(names_a, "a_first", "left_semi"), b_names if names_b is None else b_names.join(names_b, "b_first", "left_semi"), k)[0]

    with tell.within(spark, 10, 60, "score"):
        lists, best_b = listed(a_names, b_names, LENGTH, observe=True)
    best, lists = S.top_rows(own, lists, rows, longer, max(n_a, n_b))
    tell(64, "assign")
    first = rows.agg(F.min("b_idx").alias("_first"))  # one row
    base = own.join(best, "a_idx", "left").crossJoin(first).withColumn("best_idx", F.coalesce("best_idx", "_first")).withColumn("points", F.coalesce("points", F.lit(0))).drop("_first")
    base = written(base, "best")
    tell(68, "assign")
    takers = base.where(F.col("points") >= thresholds.floor * 10000).select("a_idx", "a_first", S.turn_of(F.col("points"), F.col("a_idx")).alias("turn"), "x", "a_day")
    # whoever is served takes a row while any is left, so only so many are served
    takers = written(takers if prune_below_floor else S.first_in_turn(takers, n_b), "takers")
    tell(70, "assign")
    bound = max(n_a, n_b) if prune_below_floor else n_b  # takers are no more than rows
    held = S.serve(takers, lists, rows, longer, zero=not prune_below_floor, sizes_known=bound, told=lambda left: tell.left(left, 70, 96, "assign"))
    by_b = rows.join(best_b, "b_first", "left").crossJoin(own.agg(F.min("a_idx").alias("_first")))  # one row
    best_of_b = written(by_b.select("b_idx", F.coalesce("a_first", "_first").alias("a_idx"), (F.coalesce("points", F.lit(0)) / 10000).alias("score")), "best-of-rows")
    tell(98, "assign")
    done = R.finish(S.outcome(base, held, thresholds.floor), best_of_b, thresholds)
    done = written(done.observe(seen["done"], F.count_if("matched").alias("matched")), "done")
    if log:
        log(f"rows: {n_a} and {n_b}; changed by cleaning: {seen['a'].get['changed']} and {seen['b'].get['changed']}; names on both sides: {seen['pairs'].get['same']}")
        log(f"pairs of names: {seen['pairs'].get['pairs']}, scored above 0: {seen['pairs'].get['above']}; matched: {seen['done'].get['matched']}")
    tell(100, "done")
    top = base.where(F.col("best_idx").isNotNull()).select("a_idx", F.col("best_idx").alias("b_idx"), (F.col("points") / 10000).alias("score"))
    claims = S.claims(done, thresholds.floor)
    return Linkage(
        a, b, lists, done, R.matches(a, b, done, thresholds, a_name, b_name), R.a_only(a, b, done, top, thresholds, a_name, b_name),
        R.b_only(a, b, done, best_of_b, thresholds, a_name, b_name), R.summary(a, b, done, thresholds), R.statistics(a, b, done, claims), claims, thresholds,
    )


def shared_names(a: DataFrame, b: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME) -> DataFrame:
    """Cleaned names that both sides have."""
    clean = lambda df, n: df.select(cleaning.clean_name(F.col(n).cast("string")).alias("name")).where(F.col("name") != "")
    return clean(a, a_name).intersect(clean(b, b_name))


def changed_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows that cleaning changes."""
    clean = cleaning.clean_name(F.col(name).cast("string"))
    return df.where(~F.col(name).cast("string").eqNullSafe(clean))
