"""Conversation repair against a search over all edits, a plain recurrence for long ones, and DuckDB."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tallybridge.llm import conversation_repair, registry

WORD = re.compile(r"(s?(ua)+)?")


def plain_rows(rows):
    """Rows of one conversation in order, with the first fault of each."""
    seen, out = set(), []
    for turn, role, text in sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not stripped.strip(" \t\n\x0b\x0c\r") else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def searched(rows):
    """(cost, audit, lines) by trying every edit of every row and up to two insertions in every gap."""
    options = []
    for _, role, text, fault in rows:
        own = [(3, "D", None)]
        if fault not in ("b", "d"):
            late = int(fault == "t")
            own += [(late, "K", (role, text))] + [(2 + late, "R", (r, text)) for r in ("user", "assistant")]
        options.append(own)
    added = [(2 * n, "I" * n, lines) for n in range(3) for lines in itertools.product([("user", ""), ("assistant", "")], repeat=n)]
    best = None
    for choice in itertools.product(*options):
        for gaps in itertools.product(added, repeat=len(rows) + 1):
            cost = sum(c[0] for c in choice) + sum(g[0] for g in gaps)
            if best and cost > best[0]:
                continue
            lines = list(gaps[0][2])
            audit = gaps[0][1]
            for c, g in zip(choice, gaps[1:]):
                lines += [c[2]] if c[2] else []
                lines += g[2]
                audit += c[1] + g[1]
            if WORD.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                best = min(best, (cost, audit, lines), key=lambda x: x[:2]) if best else (cost, audit, lines)
    return best


def recurrence(rows):
    """The same by a recurrence from the end, over the last initial and the rows left; insertions are at most two in a row."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def rest(last, k, inserted):
        found = [(0, "", ())] if k == len(rows) and last in ("", "a") else []
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in follow[last]:
                    c, a, lines = rest(role[0], k, inserted + 1)
                    found.append((c + 2, "I" + a, ((role, ""), *lines)))
        if k < len(rows):
            _, role, text, fault = rows[k]
            c, a, lines = rest(last, k + 1, 0)
            found.append((c + 3, "D" + a, lines))
            if fault not in ("b", "d"):
                for edit, r, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if r[:1] and r[0] in follow[last]:
                        c, a, lines = rest(r[0], k + 1, 0)
                        found.append((c + cost + (fault == "t"), edit + a, ((r, text), *lines)))
        return min(found, default=(1 << 60, "~", ()))

    for k in range(len(rows), -1, -40):  # short steps of recursion
        for last in follow:
            rest(last, k, 0)
    return rest("", 0, 0)


def expected(conv_id, rows, solve):
    rows = plain_rows(rows)
    cost, audit, lines = solve(rows)
    turns, kinds = [t for t, *_ in rows if t is not None], Counter(r[3] for r in rows)
    illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, kinds["b"], kinds["d"], kinds["t"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def some_conversations(n, longest, seed):
    rng = random.Random(seed)
    role = lambda: rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "unknown", None])
    text = lambda: rng.choice(["", " \n", "Yes.", "Yes. ", "No", "é?\n", "a b!", None, f"{rng.random()}."])
    return {k if k else None: [(rng.choice([None, *range(8)]), role(), text()) for _ in range(rng.randint(1, longest))] for k in range(n)}


def run(spark, conversations):
    data = [(k, t, r, x, "x") for k, rows in conversations.items() for t, r, x in rows]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost string").repartition(3)
    return sorted(map(tuple, conversation_repair.repair(df).collect()), key=str)


def test_table_of_the_grammar():
    for length in range(7):
        for word in map("".join, itertools.product("sua", repeat=length)):
            stacks = [conversation_repair.TOPS[0]]
            for t in word:
                stacks = [s for x in stacks for s in conversation_repair.shifted(x, t)]
            assert any(map(conversation_repair.accepts, stacks)) == bool(WORD.fullmatch(word)), word


def test_against_all_edits(spark):
    few = some_conversations(60, 3, 2)
    assert run(spark, few) == sorted((expected(k, rows, searched) for k, rows in few.items()), key=str)
    assert all(expected(k, rows, searched) == expected(k, rows, recurrence) for k, rows in few.items())


@pytest.mark.parametrize("rows,chars", [(4096, 4 << 20), (3, 4 << 20), (4096, 40)])
def test_pieces_give_what_whole_conversations_give(spark, monkeypatch, rows, chars):
    many = some_conversations(40, 30, 3) | {10**6: [(t % 300, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 700}." if t % 5 else "same") for t in range(1000)]}
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", rows)  # tasks get the values by way of the pickled functions below
    monkeypatch.setattr(conversation_repair, "PIECE_CHARS", chars)
    limits = conversation_repair._Piece.full
    monkeypatch.setattr(conversation_repair._Piece, "full", limits)
    assert run(spark, many) == sorted((expected(k, x, recurrence) for k, x in many.items()), key=str)


def test_chained_pieces_choose_the_same_way():
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randint(1, 25)))
        cuts = sorted({0, len(codes), *(rng.randint(0, len(codes)) for _ in range(4))})
        pieces = []
        for i, j in zip(cuts, cuts[1:]):
            p = conversation_repair._Piece(1, len(pieces))
            p.codes, p.rows, p.copies = [codes[i:j]], [("user", "")], [1]
            pieces.append(conversation_repair._as_piece(p, 0))
        cost, ways, tail = conversation_repair._way(pieces)
        audit = "".join(p["audits"][p["ranks"][e * 4 + t]] for p, (e, t) in zip(pieces, ways)) + tail
        assert (cost, audit) == conversation_repair.parse(codes), codes


def test_hot_conversation_is_split(spark):
    """One conversation with most rows, and one row with very many copies."""
    df = spark.range(60000).selectExpr("IF(id % 3 = 0, id, -1) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text").union(spark.range(5000).selectExpr("-2L", "1L", "'user'", "'again.'"))
    prepared = conversation_repair._prepared(df)
    sizes = [r["count"] for r in prepared.groupBy("conv_id").agg({"copies": "sum", "*": "count"}).withColumnRenamed("count(1)", "count").where("conv_id = -2").collect()]
    assert sizes == [5]
    from pyspark.sql import functions as F

    parts = [r["count"] for r in prepared.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(parts) < 2 * sum(parts) / len(parts)
    got = {r.conv_id: r for r in conversation_repair.repair(df).where("conv_id < 0").collect()}
    assert got[-2].duplicate == 4999 and got[-2].audit == "K" + "D" * 4999 + "I" and got[-2].cost == 3 * 4999 + 2
    assert got[-1].audit.count("K") == len(got[-1].audit) - got[-1].audit.count("R") - got[-1].audit.count("I") - got[-1].audit.count("D")


def test_empty_and_blank(spark):
    assert run(spark, {1: [(None, None, None)]}) == [(1, 0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_damage(spark):
    rows = [(k, t, "assistant", "One. Two! Three?") for k in range(40) for t in (None, 0, 1)] + [(None, 3, None, None)]
    got = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for k, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            want += [(k, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_query_against_duckdb(spark, size):
    path = f"/root/testdata/{size}/conversations.parquet"
    got = registry.QUERIES["op11_conversation_repair"](spark, f"/root/testdata/{size}")
    assert got.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(registry.ORACLE_SQL["op11_conversation_repair"]).fetchall())
