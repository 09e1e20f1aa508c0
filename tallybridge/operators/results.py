"""Result tables of a linkage run: matches, records of one side only, summary and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import vocab as V
from .explain import explain, explain_text
from .scoring import Thresholds

OCCUPIED_A = "最佳候选流水已被另一条客户记录匹配（一对一约束），建议核对是否一对多"
OCCUPIED_B = "最佳候选客户已被另一条流水匹配（一对一约束），本笔可能为重复入账，建议核对是否一对多"
NEAR = "候选相似度仍低于匹配阈值，建议人工核实是否同一主体"
ADVICE_A = ("B系统无可信候选，建议核实是否为未达账项或单据缺失", "B系统无可信候选（最高<55%），建议核实该笔款项是否已入账")
ADVICE_B = ("A系统无可信客户，可能为新客户，建议补充客户档案", "A系统无可信客户（最高<55%），建议核实是否为销售未开票或预收款")


def cell(df: DataFrame, name: str, default: str = "") -> Column:
    """A column as text where it exists and is not null; else ``default``."""
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def number(df: DataFrame, name: str) -> Column:
    return cleaning.lenient_number(F.col(name)) if name in df.columns else F.lit(0.0)


def advice(score: Column, occupied: Column, taken: str, lower: tuple[str, str]) -> Column:
    return F.when(occupied, taken).when(score < 40, lower[0]).when(score < 55, lower[1]).otherwise(NEAR)


def _numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 by ``order``: ranges are counted first, so no window holds the whole table."""
    spans = df.withColumn("_span", F.floor(F.col(order) / 65536))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per 65,536 ids
    offsets = counts.select("_span", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_span").orderBy(order))
    return spans.join(offsets, "_span").withColumn(name, within + F.col("_before")).drop("_span", "_before")


def finish(assigned: DataFrame, best_of_b: DataFrame, t: Thresholds) -> DataFrame:
    """Assignment rows with ``matched``, ``mutual``, ``tier``; a row counts as matched by its assignment, not by its score alone."""
    best = best_of_b.select("b_idx", F.col("a_idx").alias("_best_a"))
    out = assigned.join(best, "b_idx", "left")
    matched = F.col("assigned") & (F.col("score") >= t.floor)
    return out.select(*assigned.columns, matched.alias("matched"), F.coalesce(F.col("_best_a") == F.col("a_idx"), F.lit(False)).alias("mutual"), F.when(matched, t.tier(F.col("score"))).otherwise(V.TIERS[-1]).alias("tier"))


def matches(a: DataFrame, b: DataFrame, done: DataFrame, t: Thresholds, a_name: str = "客户名称", b_name: str = "对方户名") -> DataFrame:
    """The matched pairs, numbered in ledger order."""
    left = a.select("a_idx", cell(a, "客户编码").alias("a_code"), cleaning.raw_name(F.col(a_name)).alias("a_name"), number(a, "交易金额（元）").alias("a_amount"), cell(a, "交易日期").alias("day"))
    right = b.select("b_idx", cleaning.raw_name(F.col(b_name)).alias("b_name"), number(b, "交易金额（元）").alias("b_amount"))
    m = _numbered(done.where("matched").join(left, "a_idx").join(right, "b_idx"), "a_idx", "seq")
    tags = explain(F.col("a_name"), F.col("b_name"), score=F.col("score"), displaced=F.col("displaced"), mutual=F.col("mutual"), low=t.low, floor=t.floor)
    return m.select(
        F.col("seq").alias("匹配序号"), F.col("a_code").alias("A系统-客户编码"), F.col("a_name").alias("A系统-客户名称"), F.col("b_name").alias("B系统-对方户名"),
        F.bround("score", 1).alias("相似度(%)"), F.col("tier").alias("匹配状态"), F.col("a_amount").alias("A系统-交易金额"), F.col("b_amount").alias("B系统-交易金额"),
        F.bround(F.col("a_amount") - F.col("b_amount"), 2).alias("金额差异"), F.col("day").alias("交易日期"), explain_text(tags).alias("备注"),
    )


def a_only(a: DataFrame, b: DataFrame, done: DataFrame, top: DataFrame, t: Thresholds, a_name: str = "客户名称", b_name: str = "对方户名") -> DataFrame:
    """Ledger rows without a match, each with its best candidate by score (``top``: one row per a_idx) and advice."""
    taken = done.where("matched").select(F.col("b_idx").alias("_taken")).distinct()
    names = b.select(F.col("b_idx").alias("_b"), cleaning.raw_name(F.col(b_name)).alias("_name"))
    rest = a.join(done.where("matched").select("a_idx"), "a_idx", "left_anti")
    best = top.select("a_idx", F.col("b_idx").alias("_b"), F.col("score").alias("_score"))
    rows = rest.join(best, "a_idx", "left").join(names, "_b", "left").join(taken, F.col("_b") == F.col("_taken"), "left")
    rows = _numbered(rows, "a_idx", "seq").withColumn("_score", F.coalesce("_score", F.lit(0.0)))
    occupied = (F.col("_score") >= t.floor) & F.col("_taken").isNotNull()
    return rows.select(
        F.col("seq").alias("序号"), cell(a, "客户编码").alias("客户编码"), cleaning.raw_name(F.col(a_name)).alias("客户名称"), number(a, "交易金额（元）").alias("交易金额（元）"),
        cell(a, "交易日期").alias("交易日期"), cell(a, "业务类型").alias("业务类型"), cell(a, "部门").alias("部门"), F.bround("_score", 2).alias("最高相似度(%)"),
        F.coalesce("_name", F.lit("")).alias("B系统最佳候选"), advice(F.col("_score"), occupied, OCCUPIED_A, ADVICE_A).alias("处理建议"),
    )


def b_only(a: DataFrame, b: DataFrame, done: DataFrame, best_of_b: DataFrame, t: Thresholds, a_name: str = "客户名称", b_name: str = "对方户名") -> DataFrame:
    """Statement rows that no matched ledger row took, each with its best candidate and advice."""
    rest = b.join(done.where("matched").select("b_idx"), "b_idx", "left_anti")
    names = a.select(F.col("a_idx").alias("_a"), cleaning.raw_name(F.col(a_name)).alias("_name"))
    held = done.select(F.col("a_idx").alias("_a"), F.col("b_idx").alias("_held"))
    best = best_of_b.select("b_idx", F.col("a_idx").alias("_a"), F.col("score").alias("_score"))
    rows = rest.join(best, "b_idx", "left").join(names, "_a", "left").join(held, "_a", "left")
    rows = _numbered(rows, "b_idx", "seq").withColumn("_score", F.coalesce("_score", F.lit(0.0)))
    occupied = F.coalesce((F.col("_score") >= t.floor) & (F.col("_held") != F.col("b_idx")), F.lit(False))
    return rows.select(
        F.col("seq").alias("序号"), cleaning.raw_name(F.col(b_name)).alias("对方户名"), cell(b, "对方账号").alias("对方账号"), number(b, "交易金额（元）").alias("交易金额（元）"),
        cell(b, "交易日期").alias("交易日期"), cell(b, "流水号").alias("流水号"), cell(b, "摘要").alias("摘要"), F.bround("_score", 2).alias("最高相似度(%)"),
        F.coalesce("_name", F.lit("")).alias("A系统最佳候选"), advice(F.col("_score"), occupied, OCCUPIED_B, ADVICE_B).alias("处理建议"),
    )


def tier_counts(a: DataFrame, done: DataFrame) -> DataFrame:
    """Ledger rows per tier, all five tiers kept."""
    tiers = done.sparkSession.createDataFrame(list(enumerate(V.TIERS)), "place int, tier string")
    own = a.select("a_idx").join(done.select("a_idx", "tier"), "a_idx", "left").groupBy(F.coalesce("tier", F.lit(V.TIERS[-1])).alias("tier")).agg(F.count("*").alias("n"))
    return tiers.join(own, "tier", "left").select("place", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def summary(a: DataFrame, b: DataFrame, done: DataFrame, t: Thresholds) -> DataFrame:
    """Nine metrics in order: metric, count, share."""
    tiers = tier_counts(a, done).agg(*(F.sum(F.when(F.col("place") == k, F.col("n")).otherwise(0)).alias(f"t{k}") for k in range(5)))
    totals = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb"))).crossJoin(tiers)  # one row each
    totals = totals.crossJoin(done.agg(F.count_if("matched").alias("m"), F.count_distinct(F.when(F.col("matched"), F.col("b_idx"))).alias("mb")))
    share = lambda n, d: f"CASE WHEN {d} = 0 THEN 0D ELSE bround({n} / {d}, 4) END"
    rows = [
        ("A系统总记录数", "na", "1D"), ("B系统总记录数", "nb", "1D"), ("完全匹配（100%）", "t0", share("t0", "na")), (f"高度匹配（≥{t.high:g}%）", "t1", share("t1", "na")),
        (f"中低匹配（{t.low:g}% ≤ score < {t.high:g}%）", "t2", share("t2", "na")), (f"低置信度匹配（<{t.low:g}%）", "t3", share("t3", "na")), ("A系统独有记录", "t4", share("t4", "na")),
        ("B系统独有记录", "nb - mb", share("(nb - mb)", "nb")), ("总匹配成功数", "m", share("m", "na")),
    ]
    stacked = ", ".join(f"{k}, '{name}', CAST({n} AS BIGINT), CAST({p} AS DOUBLE)" for k, (name, n, p) in enumerate(rows, 1))
    return totals.selectExpr(f"stack({len(rows)}, {stacked}) AS (place, metric, n, share)")


def summary_note(t: Thresholds) -> str:
    return (
        "说明：完全匹配 / 高度匹配 / 中低匹配 / 低置信度匹配 / A系统独有 的占比以「A系统总记录数」为分母；B系统独有的占比以「B系统总记录数」为分母。"
        f"相似度按清洗（去空格、统一全半角括号、统一大小写）后的名称计算，识别阈值 {t.floor:g}%，分档阈值 {t.low:g}% / {t.high:g}%。"
    )


def statistics(a: DataFrame, b: DataFrame, done: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: pairs compared, exact scores, wanted statement rows and their claimants (``claims``: n of every claim), displaced, claimed, mutual."""
    one = done.agg(F.count_if(F.col("matched") & (F.col("score") >= 100)).alias("exact_100"), F.count_if("displaced").alias("displaced"), F.count_distinct(F.when(F.col("matched"), F.col("b_idx"))).alias("b_claimed"), F.count_if(F.col("matched") & F.col("mutual")).alias("mutual_best"))
    wanted = claims.where("n > 1 AND rank = 1").agg(F.count("*").alias("conflict_targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("conflict_rows"))
    sizes = a.agg(F.count("*").alias("_na")).crossJoin(b.agg(F.count("*").alias("_nb")))
    return sizes.crossJoin(one).crossJoin(wanted).withColumn("pairs", F.col("_na") * F.col("_nb")).drop("_na", "_nb")


def tag_histogram(tags: DataFrame, column: str = "tags", rows: str | None = None) -> DataFrame:
    """Rows per tag, the most frequent first; ``rows`` is a column that tells for how many rows one stands."""
    each = tags.select(F.explode(f"{column}.tag").alias("tag"), (F.col(rows) if rows else F.lit(1)).cast("long").alias("_rows"))
    return each.groupBy("tag").agg(F.sum("_rows").alias("n")).orderBy(F.col("n").desc(), "tag")


def status_distribution(match_table: DataFrame) -> DataFrame:
    return match_table.groupBy("匹配状态").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "匹配状态")


def reconciliation_shares(a: DataFrame, b: DataFrame, done: DataFrame) -> DataFrame:
    """Shares of matched pairs, ledger-only and statement-only rows in their sum."""
    n = summary(a, b, done, Thresholds()).where(F.col("place").isin(7, 8, 9)).agg(*(F.max(F.when(F.col("place") == p, F.col("n"))).alias(c) for p, c in ((9, "matched"), (7, "a_only"), (8, "b_only"))))
    total = F.col("matched") + F.col("a_only") + F.col("b_only")
    return n.select("matched", "a_only", "b_only", *(F.when(total == 0, 0.0).otherwise(F.col(c) / total).alias(f"{c}_share") for c in ("matched", "a_only", "b_only")))
