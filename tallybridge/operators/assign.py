"""Best candidates and tie-breaking over scored pairs (a_idx, b_idx, score), and one-to-one assignment over short lists of names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .nearest import FREE, choose, in_turn
from .shared import release, running, written
from .shortlist import LENGTH, LONGER


def with_tie_keys(pairs: DataFrame, a: DataFrame, b: DataFrame, *, amount: tuple[str, str] | None = None, date: tuple[str, str] | None = None) -> DataFrame:
    """Pairs with ``same_day`` and ``gap`` (absolute difference of amounts) where those columns are given; neutral values elsewhere."""
    out = pairs
    if amount:
        x = a.select("a_idx", F.col(amount[0]).try_cast("double").alias("_x"), *([F.col(date[0]).cast("string").alias("_d")] if date else []))
        y = b.select("b_idx", F.col(amount[1]).try_cast("double").alias("_y"), *([F.col(date[1]).cast("string").alias("_e")] if date else []))
        out = out.join(x, "a_idx").join(y, "b_idx")
        out = out.withColumn("gap", F.coalesce(F.abs(F.col("_x") - F.col("_y")), F.lit(float("inf"))))
        out = out.withColumn("same_day", F.coalesce(F.col("_d") == F.col("_e"), F.lit(False)) if date else F.lit(False))
        return out.drop("_x", "_y", "_d", "_e")
    return out.withColumn("gap", F.lit(0.0)).withColumn("same_day", F.lit(False))


def preference() -> list[Column]:
    """How a ledger row ranks candidates: score, same day, amount gap, then the statement's order. Scores have four places, so those within 1e-6 are equal."""
    return [F.col("score").desc(), F.col("same_day").desc(), F.col("gap").asc(), F.col("b_idx").asc()]


def ranked(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_idx").orderBy(*preference())))


def top_candidates(pairs: DataFrame, n: int = 2) -> DataFrame:
    """The n best candidates of every ledger row."""
    return ranked(pairs).where(F.col("rank") <= n)


def best_per_b(pairs: DataFrame) -> DataFrame:
    """(b_idx, a_idx, score): the best ledger row of every statement row, the first on ties."""
    w = Window.partitionBy("b_idx").orderBy(F.col("score").desc(), F.col("a_idx").asc())
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("b_idx", "a_idx", "score")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best."""
    mine = top_candidates(pairs, 1).select("a_idx", "b_idx", "score")
    return mine.join(best_per_b(pairs).select("b_idx", "a_idx"), ["a_idx", "b_idx"])


#: Takers and rows that are served one by one, and entries of lists that a task of it holds.
FEW, ENTRIES = 400_000, 1 << 22
#: Room for an index beside a score in one number, which orders by score first.
_INDEX_BITS = 43
_TOP_POINTS = 1_000_000


def turn_of(points: Column, a_idx: Column) -> Column:
    """A number that orders ledger rows by their best score, the highest first, then by index (from 0, below 2^43)."""
    return (F.lit(_TOP_POINTS).cast("long") - points) * F.lit(1 << _INDEX_BITS).cast("long") + a_idx


def first_in_turn(takers: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest ``turn``: scores are counted, and only rows of the score at the border are ranked."""
    score = F.shiftright("turn", _INDEX_BITS)
    counts = takers.groupBy(score.alias("s")).count()  # a row for each score at most, and scores are ten-thousandths
    sums = counts.withColumn("upto", F.sum("count").over(Window.orderBy("s")))
    border = sums.where(F.col("upto") > n).orderBy("s").first()
    if border is None:
        return takers
    rest = n - (border["upto"] - border["count"])
    at_border = running(takers.where(score == border["s"]), ["turn"], _k=F.lit(1)).where(F.col("_k") < rest).drop("_k")
    return takers.where(score < border["s"]).unionByName(at_border.select(*takers.columns))


def top_rows(records: DataFrame, lists: DataFrame, rows: DataFrame, longer: Callable[[DataFrame, int, DataFrame | None], DataFrame], sizes_known: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a_idx, best_idx, points) of every record whose name has a list, and the lists, made longer where a list ended among its best ones."""
    k = LENGTH
    while True:
        w = Window.partitionBy("a_first")
        top = lists.withColumn("_m", F.max("points").over(w)).where(F.col("points") == F.col("_m")).groupBy("a_first", "points", "cut").agg(F.sort_array(F.collect_list("b_first")).alias("names"))
        cut_off = written(top.where(F.col("points") <= F.col("cut")).select("a_first"), "cut-off")
        if cut_off.isEmpty():
            break
        k *= LONGER
        lists = written(lists.join(cut_off, "a_first", "left_anti").unionByName(longer(cut_off, k, None)), "lists")
    return best_rows(records, top, rows, sizes_known), lists


def best_rows(records: DataFrame, top: DataFrame, rows: DataFrame, sizes_known: int | None = None) -> DataFrame:
    """(a_idx, best_idx, points) of every record (a_idx, a_first, x, a_day) whose name has its best names in ``top`` (a_first, points, names)."""
    asked = written(records.join(top, "a_first").select("a_idx", F.lit(0).cast("long").alias("turn"), "x", "a_day", "names", "points"), "asked")
    single = rows.groupBy("b_first").agg(F.min("b_idx").alias("b_idx"), F.count("*").alias("n")).where("n = 1").select("b_first", "b_idx")
    met = asked.join(single, (F.size("names") == 1) & (F.get("names", F.lit(0)) == F.col("b_first")), "left")
    several = choose(met.where(F.col("b_idx").isNull()).select(*asked.columns), rows.withColumn("until", F.lit(FREE)), False, sizes_known=sizes_known)
    chosen = met.where(F.col("b_idx").isNotNull()).select("a_idx", "b_idx").unionByName(several)
    return chosen.join(asked.select("a_idx", "points"), "a_idx").select("a_idx", F.col("b_idx").alias("best_idx"), "points")


def serve(takers: DataFrame, lists: DataFrame, rows: DataFrame, longer: Callable[[DataFrame, int, DataFrame | None], DataFrame], *, zero: bool = True, sizes_known: int | None = None, few: int | None = None, told: Callable[[int], None] | None = None) -> DataFrame:
    """(a_idx, b_idx, points): ledger rows ``takers`` (a_idx, a_first, turn, x, a_day) one after the other take the best statement row that is left.

    With ``zero`` a row without any candidate left takes the first free one, at score 0. Where there are no more than ``few`` takers and rows they are served one by one in tasks of bounded
    size; else by rounds of proposals, which end alike. A list that has run out is made again, longer, over the names that are still open. ``told`` hears how many are still to be
    served. ``sizes_known`` is a bound of the takers and of the rows, where the caller has one.
    """
    small = sizes_known is not None and sizes_known <= (FEW if few is None else few)
    way = _serve_one_by_one if small else _serve_by_rounds
    return way(takers, lists, rows, longer, zero, sizes_known, told)


def _serve_one_by_one(takers: DataFrame, lists: DataFrame, rows: DataFrame, longer: Callable, zero: bool, sizes_known: int | None, told: Callable[[int], None] | None) -> DataFrame:
    left, held, length = takers, takers.select("a_idx", F.lit(0).cast("long").alias("b_idx"), F.lit(0).cast("long").alias("points")).limit(0), LENGTH
    while True:
        # lists stand by the first taker of each name, and as many takers are served at once as there is room for the lists of their names
        sizes = lists.groupBy("a_first").agg(F.count("*").alias("n"))
        opening = left.groupBy("a_first").agg(F.min("turn").alias("turn")).join(sizes, "a_first")
        sums = opening.withColumn("upto", F.sum("n").over(Window.orderBy("turn")))  # no more names than takers
        beyond = sums.where(F.col("upto") > ENTRIES).agg(F.min("turn")).first()[0]
        asking = left if beyond is None else left.where(F.col("turn") <= beyond)
        wants = lists.groupBy("a_first").agg(F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("p"), "b_first"))).alias("w"), F.max("cut").alias("cut"))  # no more than a list has
        wants = wants.join(opening.select("a_first", "turn"), "a_first").select("a_first", "turn", F.transform("w", lambda w: -w["p"]).alias("points"), F.col("w.b_first").alias("names"), "cut")
        asking = asking.join(wants, ["a_first", "turn"], "left")
        asking = asking.select("a_idx", "turn", "a_first", "x", "a_day", "points", "names", F.coalesce("cut", F.lit(0)).cast("long").alias("cut"), F.lit(0).alias("all"))
        free = rows.join(held, "b_idx", "left_anti").select("b_idx", "b_first", "y", "b_day", F.lit(0).alias("all"))
        served = asking.groupBy("all").cogroup(free.groupBy("all")).applyInPandas(in_turn(zero), "a_idx long, b_idx long, points long, way string")
        counts = Observation()
        served = written(served.observe(counts, *(F.count_if(F.col("way") == w).alias(w) for w in ("held", "none", "later"))), "served")
        held = written(held.unionByName(served.where("way = 'held'").select("a_idx", "b_idx", "points")), "held")
        left = written(left.join(served.where("way <> 'later'"), "a_idx", "left_anti"), "left")
        n = left.count()
        if told:
            told(n)
        if not n:
            return held
        if counts.get["later"]:
            names = written(left.select("a_first").distinct(), "short-names")
            open_names = written(rows.join(held, "b_idx", "left_anti").select("b_first").distinct(), "open-names")
            length = max(2 * length, ENTRIES // names.count())  # as long as there is room for, as few will be left
            lists = longer(names, length, open_names)


def _first_free(idle: DataFrame, rows: DataFrame) -> DataFrame:
    """(a_idx, turn, b_idx): rows of ``idle`` (a_idx, turn), in turn, each take the first statement row (b_idx, until) that no earlier turn has.

    A row is open to the first c of ``idle``, whose turns come before its ``until``. Going through rows in order, one is taken if fewer than c were taken before it. Bounds of
    that count from running sums decide rows, first of all the first undecided one, until all are decided.
    """
    queue = running(idle.select("a_idx", "turn"), ["turn"], k=F.lit(1))
    ends = rows.where(F.col("until") != FREE).select(F.col("until").alias("turn"), F.lit(0).alias("one"), "b_idx").unionByName(idle.select("turn", F.lit(1).alias("one"), F.lit(None).cast("long").alias("b_idx")))
    bounded = running(ends, ["turn"], c=F.col("one")).where(F.col("b_idx").isNotNull()).select("b_idx", "c")
    free = rows.where(F.col("until") == FREE).select("b_idx").crossJoin(idle.agg(F.count("*").alias("c")))  # one row
    line = written(free.unionByName(bounded).where("c > 0").withColumn("taken", F.lit(None).cast("boolean")), "line")
    while not line.where(F.col("taken").isNull()).isEmpty():
        counted = running(line, ["b_idx"], most=F.when(F.coalesce("taken", F.lit(True)), 1).otherwise(0), least=F.when(F.coalesce("taken", F.lit(False)), 1).otherwise(0))
        decided = F.coalesce("taken", F.when(F.col("c") > F.col("most"), True).when(F.col("c") <= F.col("least"), False))
        after = written(counted.select("b_idx", "c", decided.alias("taken")), "line")
        release(line)
        line = after
    final = running(line.select("b_idx", "taken"), ["b_idx"], k=F.when(F.col("taken"), 1).otherwise(0)).where("taken")
    return queue.join(final, "k").select("a_idx", "turn", "b_idx")


def _serve_by_rounds(takers: DataFrame, lists: DataFrame, rows: DataFrame, longer: Callable, zero: bool, sizes_known: int | None, told: Callable[[int], None] | None) -> DataFrame:
    """A row asks for the best one that is free or held by a later turn, and the earliest turn holds. Holders only ever get earlier, so what turns a row down is lost to it for good, and
    any order of asking ends alike. Rows are asked for by name: a ledger name's list tells the best names of which any row is open, and ``choose`` finds the row."""
    def with_cut(df: DataFrame) -> DataFrame:
        """Where the list of each ends."""
        cuts = lists.groupBy("a_first").agg(F.max("cut").alias("cut"))
        return df.select(*takers.columns).join(cuts, "a_first", "left").select(*takers.columns, F.coalesce("cut", F.lit(0)).alias("cut"))

    open_, idle, length = with_cut(takers), None, LENGTH
    held = takers.select(F.lit(0).cast("long").alias("b_idx"), "turn", "a_idx", F.lit(0).cast("long").alias("points")).limit(0)
    while True:
        state = rows.join(held.select("b_idx", F.col("turn").alias("until")), "b_idx", "left").withColumn("until", F.coalesce("until", F.lit(FREE)))
        latest = state.groupBy("b_first").agg(F.max("until").alias("latest"))
        seen = open_.select("a_idx", "a_first", "turn").join(lists.select("a_first", "b_first", "points"), "a_first").join(latest, "b_first").where(F.col("latest") > F.col("turn"))
        level = seen.groupBy("a_idx", "points").agg(F.sort_array(F.collect_list("b_first")).alias("names"))  # no more than a list has
        top = level.groupBy("a_idx").agg(F.max_by(F.struct("points", "names"), "points").alias("t")).select("a_idx", "t.points", "t.names")
        able = F.coalesce(F.col("points") > F.col("cut"), F.lit(False))
        counts = Observation()
        asks = open_.join(top, "a_idx", "left").withColumn("way", F.when(able, "asks").when(F.col("cut") > 0, "short").otherwise("idle"))
        asks = written(asks.observe(counts, *(F.count_if(F.col("way") == w).alias(w) for w in ("asks", "short", "idle"))), "asks")
        n = counts.get
        if told:
            told(sum(n.values()))
        if n["idle"]:
            new = asks.where("way = 'idle'").select("a_idx", "turn")
            idle = new if idle is None else written(idle.unionByName(new), "idle")
        if n["asks"]:
            asking = asks.where("way = 'asks'")
            chosen = choose(asking.select("a_idx", "turn", "x", "a_day", "names"), state, True, sizes_known=sizes_known)
            wanted = chosen.join(asking.select("a_idx", "turn", "points"), "a_idx").select("b_idx", "turn", "a_idx", "points")
        elif n["short"]:
            length *= LONGER
            short = asks.where("way = 'short'")
            names = written(short.select("a_first").distinct(), "short-names")
            earliest = takers.join(names, "a_first", "left_semi").agg(F.min("turn").alias("_t"))  # one row; of all that use these lists, as one may lose its row later
            open_names = latest.join(earliest, F.col("latest") > F.col("_t")).select("b_first")
            lists = written(lists.join(names, "a_first", "left_anti").unionByName(longer(names, length, written(open_names, "open-names"))), "lists")
            open_ = with_cut(short)
            continue
        elif zero and idle is not None:
            wanted = _first_free(idle, written(state, "state")).select("b_idx", "turn", "a_idx", F.lit(0).cast("long").alias("points"))
            idle = None
        else:
            return held
        best = held.unionByName(wanted).groupBy("b_idx").agg(F.min_by(F.struct("turn", "a_idx", "points"), "turn").alias("h")).select("b_idx", "h.turn", "h.a_idx", "h.points")
        now = written(best, "held")
        # who asked in vain asks again, and so does who has lost a row; a row is never lost to a later turn
        lost = held.select("a_idx").join(now.select("a_idx"), "a_idx", "left_anti").join(takers, "a_idx")
        open_ = with_cut(asks.where("way <> 'idle'").select(*takers.columns).join(now.select("a_idx"), "a_idx", "left_anti").unionByName(lost.select(*takers.columns)))
        held = now


def outcome(base: DataFrame, held: DataFrame, floor: float) -> DataFrame:
    """(a_idx, b_idx, score, best_idx, best_score, displaced, assigned) of every ledger row of ``base`` (a_idx, best_idx, points). One that was to be served and
    got nothing keeps its best row with score 0."""
    out = base.select("a_idx", "best_idx", "points").join(held.select("a_idx", "b_idx", F.col("points").alias("_got")), "a_idx", "left")
    taking = F.col("points") >= floor * 10000
    assigned = taking & F.col("b_idx").isNotNull()
    score = F.when(taking, F.coalesce("_got", F.lit(0))).otherwise(F.col("points")) / 10000
    return out.select("a_idx", F.coalesce("b_idx", "best_idx").alias("b_idx"), score.alias("score"), "best_idx", (F.col("points") / 10000).alias("best_score"), (assigned & F.coalesce(F.col("b_idx") != F.col("best_idx"), F.lit(False))).alias("displaced"), assigned.alias("assigned"))


def claims(done: DataFrame, floor: float = 60.0) -> DataFrame:
    """Ledger rows that want a statement row, by score: (b_idx, n, rank, a_idx, score), one row for each claim, however many a statement row has."""
    wanting = done.where(F.col("best_idx").isNotNull() & (F.col("best_score") >= floor)).select(F.col("best_idx").alias("b_idx"), "a_idx", F.col("best_score").alias("score"))
    placed = running(wanting, [F.col("score").desc(), "a_idx"], ["b_idx"], rank=F.lit(1))
    return placed.join(wanting.groupBy("b_idx").agg(F.count("*").alias("n")), "b_idx").select("b_idx", "n", (F.col("rank") + 1).cast("long").alias("rank"), "a_idx", "score")


def sample_band(results: DataFrame, low: float, high: float, k: int = 3, seed: int = 42) -> DataFrame:
    """k rows with low <= score < high, chosen by a seeded digest, in the order of a_idx."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("a_idx").cast("string")))
    return results.where((F.col("score") >= low) & (F.col("score") < high)).orderBy(drawn).limit(k).orderBy("a_idx")
