"""The best of equally scored statement rows for ledger rows: same day first, then the smallest gap of amounts, then the statement's order."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Until when a row that nobody holds is free: after all turns.
FREE = (1 << 63) - 1
#: Rows or requests of one choice that meet in a task; larger ones are compared pair by pair.
GROUP_ROWS = 1 << 20
#: Calls for each task that choices are dealt out to.
BUCKETS = 4


class _Line:
    """Places of a sorted list of which some are gone: the next one there to either side, by links that skip what is gone."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down is one off, so that 0 stands for none

    @staticmethod
    def _end(link: list[int], i: int) -> int:
        end = i
        while link[end] != end:
            end = link[end]
        while link[i] != end:
            link[i], i = end, link[i]
        return end

    def at_or_after(self, i: int) -> int:
        return self._end(self.up, i)

    def before(self, i: int) -> int:
        return self._end(self.down, i) - 1

    def remove(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


class _Pool:
    """Rows (amount, b_idx) by amount; those without an amount are as far as can be from all."""

    def __init__(self, amounts: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        finite = np.isfinite(amounts)
        order = np.lexsort((ids, amounts))
        by_amount = order[finite[order]]
        self.values, self.near, self.near_rows = amounts[by_amount].tolist(), ids[by_amount].tolist(), rows[by_amount].tolist()
        by_id = np.argsort(ids, kind="stable")
        far = by_id[~finite[by_id]]
        self.every_rows, self.far_rows = rows[by_id].tolist(), rows[far].tolist()
        self.lines = {"near": _Line(len(self.near)), "far": _Line(len(far)), "every": _Line(len(ids))}
        self.place = {name: {r: i for i, r in enumerate(x)} for name, x in (("near", self.near_rows), ("far", self.far_rows), ("every", self.every_rows))}
        self.size = len(ids)

    def remove(self, row: int) -> None:
        self.size -= 1
        for name, line in self.lines.items():
            if row in self.place[name]:
                line.remove(self.place[name][row])

    def best(self, amount: float) -> int:
        if not np.isfinite(amount):
            return self.every_rows[self.lines["every"].at_or_after(0)]
        line, v = self.lines["near"], self.values
        at = bisect_left(v, amount)
        right, left = line.at_or_after(at), line.before(at)
        if left >= 0:
            left = line.at_or_after(bisect_left(v, v[left]))  # the first of equal amounts
        if left < 0 and right == len(v):
            return self.far_rows[self.lines["far"].at_or_after(0)]
        if left < 0 or right < len(v) and (abs(amount - v[right]), self.near[right]) < (abs(amount - v[left]), self.near[left]):
            return self.near_rows[right]
        return self.near_rows[left]


class Offers:
    """Statement rows for which requests (amount, day) come one after the other."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.amounts = rows["b_idx"].to_numpy(), rows["y"].to_numpy(float, na_value=np.nan)
        self.days = [d if isinstance(d, str) else None for d in rows["b_day"]]
        number = np.arange(len(self.ids))
        self.all = _Pool(self.amounts, self.ids, number)
        places: dict = {}
        for i, d in enumerate(self.days):
            if d is not None:
                places.setdefault(d, []).append(i)
        self.by_day = {d: _Pool(self.amounts[i], self.ids[i], number[i]) for d, i in places.items()}

    def remove(self, i: int) -> None:
        self.all.remove(i)
        if self.days[i] is not None:
            self.by_day[self.days[i]].remove(i)

    def best(self, amount: float, day) -> int:
        """The place of the best row; some row must be left."""
        pool = self.by_day.get(day) if isinstance(day, str) else None
        return (pool if pool and pool.size else self.all).best(amount)

    def rank(self, i: int, amount: float, day) -> tuple:
        gap = abs(amount - self.amounts[i])
        return not (isinstance(day, str) and self.days[i] == day), float("inf") if np.isnan(gap) else gap, int(self.ids[i])


def _chooser(serial: bool):
    def one(r: pd.DataFrame, rows: pd.DataFrame, out: list) -> None:
        offers = Offers(rows)
        until, gone = rows["until"].to_numpy(), 0
        leaving = np.argsort(until, kind="stable")
        there = np.ones(len(until), bool)
        for a, turn, x, day in zip(r["a_idx"].tolist(), r["turn"].tolist(), r["x"].to_numpy(float, na_value=np.nan).tolist(), r["a_day"].tolist()):
            while serial and gone < len(until) and until[leaving[gone]] < turn:
                if there[leaving[gone]]:
                    there[leaving[gone]] = False
                    offers.remove(leaving[gone])
                gone += 1
            if not offers.all.size:
                break
            i = offers.best(x, day)
            out.append((a, int(offers.ids[i])))
            if serial:
                there[i] = False
                offers.remove(i)

    def choose(requests: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(requests) and len(rows):
            requests, rows = requests.sort_values(["g", "turn"], kind="stable"), rows.sort_values("h", kind="stable")
            (g, first), (h, begin) = (np.unique(x.to_numpy(object).astype(str), return_index=True) for x in (requests["g"], rows["h"]))
            first, begin = [*first.tolist(), len(requests)], [*begin.tolist(), len(rows)]
            where = {name: k for k, name in enumerate(h.tolist())}
            for k, name in enumerate(g.tolist()):
                if (j := where.get(name)) is not None:
                    one(requests.iloc[first[k] : first[k + 1]], rows.iloc[begin[j] : begin[j + 1]], out)
        return pd.DataFrame(out, columns=["a_idx", "b_idx"]).astype("int64")

    return choose


def in_turn(zero: bool):
    """A function for a bounded number of takers (a_idx, turn, a_first, x, a_day, points, names, cut), one after the other, and the rows that are free: (a_idx, b_idx, points, way).

    ``points`` and ``names`` are the list of a taker's name, the best first; one taker of a name has it for all. ``way`` is held, or none for a taker that nothing is left for; from
    the first one whose list has run out before it is known to be whole, all are ``later``.
    """
    def serve(takers: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b_idx").reset_index(drop=True)
        by_name = {name: group for name, group in rows.groupby("b_first")}
        left = {name: len(group) for name, group in by_name.items()}
        offers: dict = {}
        free = dict.fromkeys(zip(rows["b_idx"].tolist(), rows["b_first"].tolist()))  # in order
        place = {name: {b: i for i, b in enumerate(group["b_idx"].tolist())} for name, group in by_name.items()}

        def offered(name: int) -> Offers:
            if name not in offers:
                offers[name] = Offers(by_name[name])
            return offers[name]

        def take(name: int, i: int) -> int:
            b = int(offered(name).ids[i])
            offers[name].remove(i)
            left[name] -= 1
            del free[(b, name)]
            return b

        out, later = [], False
        listed = {name: (p, n, cut) for name, p, n, cut in zip(takers["a_first"].tolist(), takers["points"], takers["names"], takers["cut"].tolist()) if p is not None}
        start: dict = {}  # where the open names of a list begin; a name that is closed stays so
        r = takers.sort_values("turn")
        for a, own, x, day in zip(r["a_idx"].tolist(), r["a_first"].tolist(), r["x"].to_numpy(float, na_value=np.nan).tolist(), r["a_day"].tolist()):
            if later or not free:
                out.append((a, None, 0, "later" if later else "none"))
                continue
            points, names, cut = listed.get(own, ((), (), 0))
            k = start.get(own, 0)
            while k < len(names) and not left.get(names[k]):
                k += 1
            start[own] = k
            found = None
            if k < len(names) and points[k] > cut:
                top = points[k]
                while k < len(names) and points[k] == top:
                    if left.get(names[k]):
                        name = int(names[k])
                        i = offered(name).best(x, day)
                        key = offers[name].rank(i, x, day)
                        if not found or key < found[0]:
                            found = (key, name, i)
                    k += 1
            if found:
                out.append((a, take(found[1], found[2]), int(top), "held"))
            elif cut > 0:
                later = True
                out.append((a, None, 0, "later"))
            elif zero:
                b, name = next(iter(free))
                out.append((a, take(name, place[name][b]), 0, "held"))
            else:
                out.append((a, None, 0, "none"))
        return pd.DataFrame(out, columns=["a_idx", "b_idx", "points", "way"]).astype({"a_idx": "int64", "b_idx": "Int64", "points": "int64"})

    return serve


def choose(requests: DataFrame, rows: DataFrame, serial: bool, large: int = GROUP_ROWS, sizes_known: int | None = None) -> DataFrame:
    """(a_idx, b_idx): for every request the best of the rows of its names.

    requests: a_idx, turn, x, a_day, names (array of b_first, sorted); rows: b_first, b_idx, y, b_day, until. With ``serial`` a row serves only turns before ``until``, and requests
    for the same names are served in turn, each row once. A choice of over ``large`` rows or requests is made by comparing its pairs, without that last rule; whoever
    calls it settles who wants the same row anyway. ``sizes_known`` is a bound of both counts, where the caller has one.
    """
    asked = requests.withColumn("g", F.array_join("names", ","))
    groups = asked.select(F.col("g").alias("h"), "names").distinct().select("h", F.explode("names").alias("b_first"))
    offered = groups.join(rows, "b_first")
    small_a, small_b, wide = asked, offered, None
    if sizes_known is None or sizes_known > large:
        counts = asked.groupBy("g").count().union(offered.groupBy("h").count()).groupBy("g").agg(F.max("count").alias("n")).where(F.col("n") > large).select(F.col("g").alias("many"))
        counts = written(counts, "large-choices")
        small_a, small_b = asked.join(counts, F.col("g") == F.col("many"), "left_anti"), offered.join(counts, F.col("h") == F.col("many"), "left_anti")
        met = asked.join(counts, F.col("g") == F.col("many")).drop("names").join(offered, F.col("h") == F.col("many"))
        met = met.where(F.col("until") > F.col("turn")) if serial else met
        gap = F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(float("inf")))
        key = F.struct((~F.coalesce(F.col("a_day") == F.col("b_day"), F.lit(False))).alias("d"), gap.alias("gap"), "b_idx")
        wide = met.groupBy("a_idx").agg(F.min(key).alias("k")).select("a_idx", F.col("k.b_idx").alias("b_idx"))
    # many choices are small, so a call makes those of a bucket
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets).cast("long"))
    spark = requests.sparkSession
    buckets = BUCKETS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    small_a, small_b = small_a.drop("names").withColumn("_k", bucket("g")), small_b.withColumn("_k", bucket("h"))
    chosen = small_a.groupBy("_k").cogroup(small_b.groupBy("_k")).applyInPandas(_chooser(serial), "a_idx long, b_idx long")
    return chosen if wide is None else chosen.unionByName(wide)
