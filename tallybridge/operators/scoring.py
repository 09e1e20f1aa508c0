"""Candidate pairs and their scores.

Scores depend on cleaned names alone, so pairs are made and scored between distinct names; records meet their scores afterwards. Everything that
depends on one name is computed before the pairs are made. The default compares all names of one side with all of the other, as the method
asks; the side that is broadcast is checked for size. Blocking on shared character pairs is optional and loses pairs that share none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import cleaning, folding, similarity
from ..functions import vocab as V

#: What scores can be made of; the weights of one measure are 1.
ALGORITHMS = {"weighted": V.WEIGHTS} | {k: {k: 1.0} for k in ("ratio", "partial", "wratio", "core", "jaro_winkler")}
#: Names that are sent to all tasks at most; above, both sides are dealt out in a grid of tiles of so many names a side.
BROADCAST_NAMES, TILE_NAMES = 200_000, 5_000


@dataclass(frozen=True)
class Thresholds:
    high: float = 90.0
    low: float = 70.0
    floor: float = 60.0

    def __post_init__(self) -> None:
        if not 100 >= self.high >= self.low >= self.floor >= 0:
            raise ValueError(f"thresholds must satisfy 100 >= high >= low >= floor >= 0: {self}")

    def tier(self, score: Column) -> Column:
        exact, high, mid, low, none = V.TIERS
        return F.when(score >= 100, exact).when(score >= self.high, high).when(score >= self.low, mid).when(score >= self.floor, low).otherwise(none)

    def label(self) -> str:
        return f"{self.high:g}/{self.low:g}/{self.floor:g}"


def describe(algorithm: str) -> str:
    weights = _weights(algorithm)
    return " + ".join(f"{w:g} {k}" for k, w in weights.items())


def _weights(algorithm: str) -> dict[str, float]:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    return ALGORITHMS[algorithm]


def in_blocks(algorithm: str) -> bool:
    """Whether all names can be scored with all by ``grid``."""
    return "jaro_winkler" not in _weights(algorithm)


def names(records: DataFrame, name: str, side: str, key: str | None = None) -> DataFrame:
    """Distinct cleaned names of one side with all that rules need of a name, columns prefixed by ``side``; with ``key`` also ``first``, the smallest key of its records."""
    clean = records.select(cleaning.clean_name(F.col(name).cast("string")).alias("clean"), *([F.col(key).alias("first")] if key else []))
    clean = clean.groupBy("clean").agg(F.min("first").alias("first")) if key else clean.distinct()
    out = clean.select(*clean.columns, cleaning.strip_punct(F.col("clean")).alias("core"), cleaning.strip_parens(F.col("clean")).alias("bare"), folding.collapse_generic(F.col("clean")).alias("fold"), folding.protected_in(F.col("clean")).alias("protected"))
    out = out.withColumn("industry", folding.collapse_industry(F.col("fold")))
    return out.select(*(F.col(c).alias(f"{side}_{c}") for c in out.columns))


def candidates(a: DataFrame, b: DataFrame, blocking: str | None = None) -> DataFrame:
    """Pairs of names. ``blocking="bigram"`` keeps pairs with a common pair of neighbouring characters, or equal punctuation-free names."""
    if blocking == "bigram":
        def keyed(df: DataFrame, side: str) -> DataFrame:
            text = F.col(f"{side}_clean")
            grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
            return df.select(text, F.explode(F.array_distinct(grams)).alias("gram"))

        met = keyed(a, "a").join(keyed(b, "b"), "gram").select("a_clean", "b_clean").distinct()
        return met.join(a, "a_clean").join(b, "b_clean")
    if blocking is not None:
        raise ValueError(f"unknown blocking {blocking!r}")
    n = b.count()
    if n <= BROADCAST_NAMES:
        # names are small but what is made of them is not: a fixed number of partitions, which AQE does not merge
        spark = a.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return a.repartition(parts).crossJoin(F.broadcast(b))
    return _grid(a, b, -(-a.count() // TILE_NAMES), -(-n // TILE_NAMES))


def _grid(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    """All pairs by a join of equal tiles: a name goes to one row or column of the grid and is copied along it, so a task holds one tile's names of either side."""
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(n, 1)).cast("long"))
    left = a.withColumn("tile_a", own("a_clean", rows)).withColumn("tile_b", across(columns))
    right = b.withColumn("tile_b", own("b_clean", columns)).withColumn("tile_a", across(rows))
    return left.join(right, ["tile_a", "tile_b"]).drop("tile_a", "tile_b")


def base_score(algorithm: str = "weighted") -> Column:
    return sum((F.col(k) * w for k, w in _weights(algorithm).items()), F.lit(0.0))


def ruled(score: Column, penalty: Column) -> Column:
    """The rules in order: core penalty, same fold, same line-free name, protected names, containment, equal names; clipped and rounded."""
    c = F.col
    score = score * penalty
    same_fold = (c("a_fold") != "") & (c("a_fold") == c("b_fold"))
    score = F.when(same_fold, F.greatest(score, F.lit(V.SAME_FOLD_SCORE))).otherwise(score)
    had_line = (c("a_industry") != c("a_fold")) & (c("b_industry") != c("b_fold"))
    related = (c("a_industry") != "") & (c("a_industry") == c("b_industry")) & had_line & (score < V.INDUSTRY_BELOW)
    score = F.when(related, F.least(score * V.INDUSTRY_FACTOR, F.lit(V.INDUSTRY_TOP))).otherwise(score)
    score = F.when(c("a_protected") != c("b_protected"), F.least(score * V.CONFLICT_FACTOR, F.lit(V.CONFLICT_TOP))).otherwise(score)
    score = F.greatest(score, contained_score())
    equal = ((c("a_core") == c("b_core")) & (c("a_core") != "")) | ((c("a_clean") == c("b_clean")) & (c("a_clean") != ""))
    score = F.when(equal, F.lit(100.0)).otherwise(score)
    return F.rint(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)) * 10000) / 10000


def contained_score() -> Column:
    """What a name that lies in the other one is lifted to; 0 where none does."""
    a, b = F.col("a_clean"), F.col("b_clean")
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n, m = F.length(short), F.length(long)
    edge = F.startswith(long, short) | F.endswith(long, short)
    lifted = F.lit(100.0) - (F.lit(1.0) - n / m) * F.when(edge, V.CONTAINED_EDGE).otherwise(V.CONTAINED_INSIDE)
    lifted = F.when(n <= V.CONTAINED_SHORT_LENGTH, F.greatest(lifted, F.lit(V.CONTAINED_SHORT))).otherwise(lifted)
    return F.when((n >= V.CONTAINED_LEAST_LENGTH) & (n < m) & F.contains(long, short), lifted).otherwise(F.lit(0.0))


def contained_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_clean, b_clean, lift) of names of which one lies in the other, by equality of a name with a part of a longer one.

    A longer name gives its parts of those lengths that names of the other side have, of which there are no more than their longest has characters.
    """
    def within(long: DataFrame, short: DataFrame, l: str, s: str) -> DataFrame:
        fitting = short.where(F.length(s) >= V.CONTAINED_LEAST_LENGTH).select(s)
        lengths = sorted(r[0] for r in fitting.select(F.length(s)).distinct().collect())
        shorter = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n < F.length(l))
        parts = F.flatten(F.transform(shorter, lambda n: F.transform(F.sequence(F.lit(1), F.length(l) - n + 1), lambda i: F.substring(F.col(l), i, n))))
        return long.select(l, F.explode(F.array_distinct(parts)).alias("part")).join(fitting, F.col("part") == F.col(s)).select("a_clean", "b_clean")

    found = within(b, a, "b_clean", "a_clean").unionByName(within(a, b, "a_clean", "b_clean"))
    return found.withColumn("lift", F.rint(contained_score() * 10000) / 10000)


def score_pairs(pairs: DataFrame, algorithm: str = "weighted", penalty_from: float = 0.0) -> DataFrame:
    """The measures, penalty, base and score of pairs of names that have all columns of ``names`` for both sides."""
    s = similarity.pair_scores("a_clean", "b_clean", "a_core", "b_core", "a_bare", "b_bare")
    pairs = pairs.withColumn("_s", s)
    if "jaro_winkler" in _weights(algorithm):
        pairs = pairs.withColumn("jaro_winkler", similarity.jaro_winkler_score("a_clean", "b_clean"))
    measures = ["ratio", "partial", "wratio", "core", "penalty"]
    pairs = pairs.select("*", *(F.col(f"_s.{m}").alias(m) for m in measures)).drop("_s")
    named = (F.col("a_clean") != "") | (F.col("b_clean") != "")
    pairs = pairs.withColumn("base", F.when(named, base_score(algorithm)).otherwise(F.lit(0.0)))
    penalty = F.col("penalty") if penalty_from <= 0 else F.when(F.col("base") >= penalty_from, F.col("penalty")).otherwise(F.lit(1.0))
    return pairs.withColumn("score", F.when(named, ruled(F.col("base"), penalty)).otherwise(F.lit(0.0)))


def score_names(a: DataFrame, b: DataFrame, algorithm: str = "weighted", blocking: str | None = None, penalty_from: float = 0.0) -> DataFrame:
    """Scored pairs of names: a_clean, b_clean, the measures, penalty, base and score. Two empty names count as 0, not as alike.

    The core penalty lowers pairs whose base score is ``penalty_from`` or more. Above 0 it can turn the order of pairs round: a likely pair is lowered
    below an unlikely one that is left as it is.
    """
    _weights(algorithm)
    return score_pairs(candidates(a, b, blocking), algorithm, penalty_from)


def observed(scored: DataFrame, seen: Observation | None) -> DataFrame:
    """Scored pairs, of which ``seen`` gets the counts pairs, above (of those above 0) and same (of names on both sides)."""
    if seen is None:
        return scored
    same = (F.col("a_clean") == F.col("b_clean")) & (F.col("a_clean") != "")
    return scored.observe(seen, F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score") > 0).alias("above"), F.count_if(same).alias("same"))


def score_records(a: DataFrame, b: DataFrame, a_name: str, b_name: str, *, a_key: str = "a_idx", b_key: str = "b_idx", algorithm: str = "weighted", blocking: str | None = None, least: float = 0.0, penalty_from: float = 0.0) -> DataFrame:
    """(a_key, b_key, score and the measures) of records whose names score above ``least``."""
    scored = score_names(names(a, a_name, "a"), names(b, b_name, "b"), algorithm, blocking, penalty_from).where(F.col("score") > least)
    left = a.select(a_key, cleaning.clean_name(F.col(a_name).cast("string")).alias("a_clean"))
    right = b.select(b_key, cleaning.clean_name(F.col(b_name).cast("string")).alias("b_clean"))
    kept = ["ratio", "partial", "wratio", "core", "penalty", "base", "score"]
    return scored.select("a_clean", "b_clean", *kept).join(left, "a_clean").join(right, "b_clean").select(a_key, b_key, *kept)
