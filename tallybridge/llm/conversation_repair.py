"""Repair of a conversation's role order by a generalised LR parse with weighted edits.

The initials of roles have to form ``(s?(ua)+)?``. A table is made from the grammar; a stack is a node (state, node below), so stacks that share what lies below
are one graph. At every row each stack may be carried on by keeping the row, giving it another role, deleting it, or inserting a row before it; equal tops are merged
and the smallest (cost, audit) stays. Audits of equal cost at one place are never prefixes of each other (the rest could only be insertions, which cost), so the
smaller one stays smaller whatever follows, and the minimum at each top is enough.

A conversation can be of any length. Rows are dealt out by ranges of (conversation, turn, role, text) and parsed where they lie. What a range holds whole is done there. Of the
rest, pieces of bounded size are parsed from every top that they can begin at; their costs, and the ranks of their audits in place of the audits, are chained over the pieces
of a conversation, and only the chosen way through each piece is then written out.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

# --- fixed values ----------------------------------------------------------------------------------------------------------------------

#: Productions; C is the start. D: whole pairs behind an optional s. U: the same with an open u.
GRAMMAR = (("C", ""), ("C", "D"), ("D", "Ua"), ("U", "u"), ("U", "su"), ("U", "Du"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GIVEN = {"u": "user", "a": "assistant"}

# --- the table -------------------------------------------------------------------------------------------------------------------------

Stack = tuple  # (state, stack below or None)


def _closure(items: frozenset) -> frozenset:
    out, work = set(items), list(items)
    while work:
        production, dot = work.pop()
        rest = GRAMMAR[production][1][dot:]
        for k, (left, _) in enumerate(GRAMMAR):
            if rest and left == rest[0] and (k, 0) not in out:
                out.add((k, 0))
                work.append((k, 0))
    return frozenset(out)


@functools.cache
def _goto(state: frozenset, symbol: str) -> frozenset | None:
    moved = frozenset((p, dot + 1) for p, dot in state if GRAMMAR[p][1][dot : dot + 1] == symbol)
    return _closure(moved) if moved else None


_START: Stack = (_closure(frozenset((k, 0) for k, (left, _) in enumerate(GRAMMAR) if left == "C")), None)


@functools.cache
def shifted(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    """The stacks after a shift of ``symbol`` and all reductions that follow; several where the table leaves a choice."""
    to = _goto(stack[0], symbol)
    out, work = [], [(to, stack)] if to else []
    while work:
        top = work.pop()
        ended = [p for p, dot in top[0] if dot == len(GRAMMAR[p][1])]
        if len(ended) < len(top[0]) or any(GRAMMAR[p][0] == "C" for p in ended):
            out.append(top)
        for left, right in (GRAMMAR[p] for p in ended if GRAMMAR[p][0] != "C"):
            below = top
            for _ in right:
                below = below[1]
            to = _goto(below[0], left)
            if to:
                work.append((to, below))
    return tuple(out)


def accepts(stack: Stack) -> bool:
    return any(GRAMMAR[p][0] == "C" and dot == len(GRAMMAR[p][1]) for p, dot in stack[0])


def _tops() -> list[Stack]:
    out = [_START]
    for stack in out:
        out += [s for t in "sua" for s in shifted(stack, t) if s not in out]
    return out


#: All stacks between two rows, the one at the start first. They are few, as the grammar is regular; a piece of a conversation may begin at any of them.
TOPS = _tops()
_NUMBER = {s: k for k, s in enumerate(TOPS)}
_NEXT = [{t: [_NUMBER[s] for s in shifted(stack, t)] for t in "sua"} for stack in TOPS]
_ENDS = [k for k, s in enumerate(TOPS) if accepts(s)]

# --- the parse -------------------------------------------------------------------------------------------------------------------------

Front = dict  # number of a top -> (cost, audit)


def _offer(front: Front, top: int, cost: int, audit: str) -> None:
    if top not in front or (cost, audit) < front[top]:
        front[top] = (cost, audit)


def inserted(front: Front) -> Front:
    """All tops within reach of insertions."""
    out, work = dict(front), list(front)
    while work:
        top = work.pop()
        cost, audit = out[top]
        for t in GIVEN:
            for to in _NEXT[top][t]:
                if to not in out or (cost + INSERT, audit + "I") < out[to]:
                    out[to] = (cost + INSERT, audit + "I")
                    work.append(to)
    return out


def after_row(front: Front, code: str) -> Front:
    """The tops behind a row. ``code``: d where it has to go, else its initial (x where it is none of s, u and a), in upper case where it is truncated."""
    out: Front = {}
    for top, (cost, audit) in inserted(front).items():
        _offer(out, top, cost + DELETE, audit + "D")
        if code == "d":
            continue
        more = TRUNCATED if code.isupper() else 0
        for to in _NEXT[top].get(code.lower(), ()):
            _offer(out, to, cost + KEEP + more, audit + "K")
        for t in GIVEN:
            for to in _NEXT[top][t]:
                _offer(out, to, cost + REROLE + more, audit + "R")
    return out


def through(codes: str, entry: int = 0) -> Front:
    """The tops behind all rows of ``codes``, from one top."""
    front: Front = {entry: (0, "")}
    for code in codes:
        front = after_row(front, code)
    return front


def end(front: Front) -> tuple[int, str]:
    """The smallest (cost, audit) at a top where a conversation may end."""
    return min(x for top, x in inserted(front).items() if top in _ENDS)


@functools.lru_cache(1 << 14)
def parse(codes: str) -> tuple[int, str]:
    return end(through(codes))


def replay(audit: str, rows: list[tuple[str, str]], top: int = 0) -> tuple[list[str], int]:
    """Lines ``role:text`` that an audit leaves of ``rows`` (role, text), from a top on, and the top that it ends at."""
    out, rest = [], iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else next(t for t in GIVEN if _NEXT[top][t])
        out.append(f"{role if edit == 'K' else GIVEN[symbol]}:{text}")
        top = _NEXT[top][symbol][0]
    return out, top


# --- rows ------------------------------------------------------------------------------------------------------------------------------

#: Copies of a row that stand as one; rows and characters of a piece; characters of a text by which ranges are cut.
COPIES, PIECE_ROWS, PIECE_CHARS, RANGE_CHARS = 1024, 4096, 4 << 20, 64

_SUMS = ["blank", "duplicate", "truncated", "illegal"]


def _faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text."""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, code, fault) in ranges, sorted: equal rows are one with its number of copies, up to ``COPIES``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    merged = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("_digest", F.xxhash64("role", "text")).withColumn("_other", F.hash("text", "role"))
    # nulls come first, so a group with one has it as its first turn; written, so that the join below has two plain sides and AQE can split a frequent key
    same = ["conv_id", "_digest", "_other"]
    first = merged.groupBy(*same).agg(F.count("*").alias("_rows"), F.min("turn").alias("_least"), F.bool_or(F.col("turn").isNull()).alias("_none"))
    first = C.materialize(first.where("_rows > 1").drop("_rows"), "first-turns").withColumnsRenamed({c: f"{c}2" for c in same})
    met = merged.join(first, (F.col("conv_id").eqNullSafe(F.col("conv_id2"))) & (F.col("_digest") == F.col("_digest2")) & (F.col("_other") == F.col("_other2")), "left")
    later = F.coalesce(F.when(F.col("_none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_least")), F.lit(False))
    parts = met.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    parts = parts.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("_k") * COPIES).cast("int"))
    blank, truncated = _faults(F.col("text"))
    fault = F.when(blank, "b").when(later | (F.col("_k") > 0), "d").when(truncated, "t").otherwise("")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    told = parts.withColumn("fault", fault).withColumn("code", F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper(known)).otherwise(known))
    nulls = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    dealt = told.repartitionByRange(C.partitions(rows.sparkSession), *nulls, "role", F.substring("text", 1, RANGE_CHARS))
    return dealt.sortWithinPartitions(*nulls, "role", "text", "_k").select("conv_id", "turn", "role", "text", "copies", "code", "fault")


class _Piece:
    """Successive rows of one conversation."""

    def __init__(self, conv_id, seg: int, further: bool = False):
        self.conv_id, self.seg, self.further = conv_id, seg, further
        self.rows, self.copies, self.codes, self.size = [], [], [], 0
        self.sums, self.turns, self.low, self.high, self.first_turn, self.last_turn = dict.fromkeys(_SUMS, 0), 0, None, None, None, None

    def add(self, turn, role, text, copies, code, fault):
        initial = role[:1]
        if self.rows:
            self.sums["illegal"] += self.rows[-1][0][:1] + initial not in ("su", "ua", "au")
        self.sums["illegal"] += copies - 1
        kind = {"b": "blank", "d": "duplicate", "t": "truncated"}
        if fault:
            self.sums[kind[fault]] += 1
        self.sums["blank" if fault == "b" else "duplicate"] += copies - 1
        if turn is not None:
            self.turns += turn != self.last_turn
            if self.first_turn is None:
                self.low = self.first_turn = turn
            self.last_turn = self.high = turn
        self.rows.append((role, text))
        self.copies.append(copies)
        self.codes.append(code + "d" * (copies - 1))
        self.size += len(text) + copies

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.size >= PIECE_CHARS

    def expanded(self) -> list[tuple[str, str]]:
        return [row for row, n in zip(self.rows, self.copies) for _ in range(n)]


_DONE = ["conv_id", "gaps", *_SUMS, "cost", "audit", "repaired_sha256"]
_LIGHT = ["part", "seg", "first", "last", "turns", "first_turn", "last_turn", "costs", "ranks"]
_HEAVY = ["audits", "roles", "texts", "copies"]
_KINDS = {
    **dict.fromkeys(["gaps", *_SUMS, "cost", "turns", "first_turn", "last_turn"], ("long", pa.int64())), **dict.fromkeys(["audit", "repaired_sha256", "first", "last"], ("string", pa.string())),
    **dict.fromkeys(["part", "seg"], ("int", pa.int32())), "costs": ("array<long>", pa.list_(pa.int64())), "ranks": ("array<int>", pa.list_(pa.int32())), **dict.fromkeys(["audits", "roles", "texts"], ("array<string>", pa.list_(pa.string()))), "copies": ("array<int>", pa.list_(pa.int32())),
    "entry": ("int", pa.int32()), "leaves": ("int", pa.int32()), "tail": ("string", pa.string()), "final": ("boolean", pa.bool_()), "lines": ("int", pa.int32()), "chunk": ("string", pa.string()),
}


def _schema(names: list[str], id_type: str) -> str:
    return ", ".join(f"{n} {id_type if n == 'conv_id' else _KINDS[n][0]}" for n in names)


def _batches(rows, names: list[str], id_type: pa.DataType, limit: int = 1 << 23):
    """Record batches of dictionaries, of about ``limit`` characters at most."""
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], id_type if n == "conv_id" else _KINDS[n][1]) for n in names], names)

    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row.values() if isinstance(x, str)) + sum(map(len, row.get("texts") or ())) + sum(map(len, row.get("audits") or ()))
        if size > limit or len(held) >= 5000:
            yield made()
            held, size = [], 0
    yield made()


def _records(batches):
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            yield dict(zip(names, values))


def _as_done(piece: _Piece) -> dict:
    cost, audit = parse("".join(piece.codes))
    text = "\n".join(replay(audit, piece.expanded())[0])
    gaps = piece.high - piece.low + 1 - piece.turns if piece.turns else 0
    return {"conv_id": piece.conv_id, "gaps": gaps, **piece.sums, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _as_piece(piece: _Piece, part: int) -> dict:
    """Costs from every top to every top (-1: no way) with the ranks of their audits."""
    codes, n = "".join(piece.codes), len(TOPS)
    ways = {entry * n + to: x for entry in range(n) for to, x in through(codes, entry).items()}
    audits = sorted({audit for _, audit in ways.values()})
    rank = {audit: k for k, audit in enumerate(audits)}
    costs, ranks = ([ways[w][0] if w in ways else -1 for w in range(n * n)], [rank[ways[w][1]] if w in ways else -1 for w in range(n * n)])
    return {
        "conv_id": piece.conv_id, **piece.sums, "part": part, "seg": piece.seg, "first": piece.rows[0][0][:1], "last": piece.rows[-1][0][:1], "turns": piece.turns, "first_turn": piece.first_turn, "last_turn": piece.last_turn,
        "costs": costs, "ranks": ranks, "audits": audits, "roles": [r for r, _ in piece.rows], "texts": [t for _, t in piece.rows], "copies": piece.copies,
    }


def _parser(batches):
    """Whole conversations done, pieces of those that may go on in another range (the first and the last of this one) or are too long for one piece."""
    id_type = None

    def rows():
        nonlocal id_type
        part, now, at_start = TaskContext.get().partitionId(), None, True
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None:
                    now = _Piece(values[0], 0)
                elif values[0] != now.conv_id:
                    yield _as_piece(now, part) if at_start or now.further else _as_done(now)
                    now, at_start = _Piece(values[0], now.seg + 1), False
                elif now.full():
                    yield _as_piece(now, part)
                    now = _Piece(values[0], now.seg + 1, True)
                now.add(*values[1:])
        if now is not None:
            yield _as_piece(now, part)

    names = [*_DONE, *_LIGHT, *_HEAVY]
    found = rows()
    ahead = next(found, None)
    if ahead is not None:
        yield from _batches(_chained(ahead, found), names, id_type)


def _chained(first, rest):
    yield first
    yield from rest


def _way(pieces: list[dict]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, (entry, exit) of every piece, insertions at the end) of the smallest (cost, audit) through the pieces of a conversation.

    A way's audit is compared by the rank of what came before and then by its rank within the piece. What came before ends in an edit of a row, so no two of them are prefixes of
    each other.
    """
    n = len(TOPS)
    front, back = {0: (0, 0)}, []  # top -> (cost, rank)
    for piece in pieces:
        best = {}
        for entry, (cost, rank) in front.items():
            for to in range(n):
                w = entry * n + to
                if piece["costs"][w] >= 0:
                    way = (cost + piece["costs"][w], rank, piece["ranks"][w], entry)
                    if to not in best or way < best[to]:
                        best[to] = way
        order = {x: k for k, x in enumerate(sorted({way[1:3] for way in best.values()}))}
        front = {to: (way[0], order[way[1:3]]) for to, way in best.items()}
        back.append({to: way[3] for to, way in best.items()})
    ends = []
    for top, (cost, rank) in front.items():
        more, audit = end({top: (0, "")})
        ends.append((cost + more, rank, audit, top))
    cost, _, tail, top = min(ends)
    ways = []
    for step in reversed(back):
        ways.append((step[top], top))
        top = step[top]
    return cost, ways[::-1], tail


_CHOSEN = ["conv_id", "gaps", *_SUMS, "cost", "part", "seg", "entry", "leaves", "tail", "final"]


def _chain(batches):
    """The chosen way through every piece; the last piece of a conversation also has its sums. Rows come in the order of (conversation, range, piece)."""
    id_type = None

    def groups():
        nonlocal id_type
        held = []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in _records([batch]):
                if held and row["conv_id"] != held[0]["conv_id"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def rows():
        for pieces in groups():
            cost, ways, tail = _way(pieces)
            sums = {c: sum(p[c] for p in pieces) for c in _SUMS}
            sums["illegal"] += sum(p["last"] + q["first"] not in ("su", "ua", "au") for p, q in zip(pieces, pieces[1:]))
            told = [p for p in pieces if p["turns"]]
            turns = sum(p["turns"] for p in told) - sum(p["last_turn"] == q["first_turn"] for p, q in zip(told, told[1:]))
            gaps = told[-1]["last_turn"] - told[0]["first_turn"] + 1 - turns if told else 0
            for k, (p, (entry, to)) in enumerate(zip(pieces, ways), 1):
                out = {"conv_id": p["conv_id"], "part": p["part"], "seg": p["seg"], "entry": entry, "leaves": to, "tail": "", "final": k == len(pieces)}
                yield out | {"gaps": gaps, **sums, "cost": cost, "tail": tail} if out["final"] else out

    found = rows()
    ahead = next(found, None)
    if ahead is not None:
        yield from _batches(_chained(ahead, found), _CHOSEN, id_type)


_WRITTEN = ["conv_id", "gaps", *_SUMS, "cost", "part", "seg", "final", "audit", "lines", "chunk"]


def _write_out(batches):
    """The audit and the lines of the chosen way through a piece."""
    n = len(TOPS)
    for batch in batches:
        def rows(batch=batch):
            for r in _records([batch]):
                audit = r["audits"][r["ranks"][r["entry"] * n + r["leaves"]]]
                lines, top = replay(audit, [(role, text) for role, text, k in zip(r["roles"], r["texts"], r["copies"]) for _ in range(k)], r["entry"])
                lines += replay(r["tail"], [], top)[0]
                yield {c: r.get(c) for c in _WRITTEN} | {"audit": audit + r["tail"], "lines": len(lines), "chunk": "\n".join(lines)}

        yield from _batches(rows(), _WRITTEN, batch.schema.field("conv_id").type)


def _join_up(batches):
    """One row for every conversation out of its pieces in order: a digest takes one text after the other, so it is a stream, one piece in memory at a time."""
    id_type = None

    def rows():
        nonlocal id_type
        digest, any_line, audit = hashlib.sha256(), False, []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for r in _records([batch]):
                if r["lines"]:
                    digest.update((("\n" if any_line else "") + r["chunk"]).encode())
                    any_line = True
                audit.append(r["audit"])
                if r["final"]:
                    yield {c: r.get(c) for c in _DONE} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    digest, any_line, audit = hashlib.sha256(), False, []

    found = rows()
    ahead = next(found, None)
    if ahead is not None:
        yield from _batches(_chained(ahead, found), _DONE, id_type)


def repair(rows: DataFrame) -> DataFrame:
    """One row for every conv_id of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in the order of turn, nulls first, then of role and text. A null role or text is one space, a null conv_id is a conversation like any other. Turns may be missing or
    repeat. Repeated rows are duplicates of the first. An empty table gives no rows; other columns are left out. The audit and the digest of a conversation are one value each,
    so its repaired text passes through one task as a stream; everything else is split, unless texts of one turn and role agree in their first 64 characters.
    """
    C.small_batches(rows.sparkSession)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    parsed = C.materialize(_prepared(rows).mapInArrow(_parser, _schema([*_DONE, *_LIGHT, *_HEAVY], id_type)), "parsed")
    done, pieces = parsed.where(F.col("part").isNull()).select(*_DONE), parsed.where(F.col("part").isNotNull())
    light = pieces.select("conv_id", *_SUMS, *_LIGHT)
    n = C.partitions(rows.sparkSession)
    chosen = C.materialize(light.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_chain, _schema(_CHOSEN, id_type)), "chosen")
    met = pieces.select("part", "seg", "ranks", *_HEAVY).join(chosen, ["part", "seg"])
    written = met.mapInArrow(_write_out, _schema(_WRITTEN, id_type))
    whole = written.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seg").mapInArrow(_join_up, _schema(_DONE, id_type))
    return done.unionByName(whole)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by the checksum of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its full stops, 3 stands twice, 4 is the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_twice")).drop("_twice")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all damaged conversations; one that the damage leaves no row of has zeros and the digest of an empty text."""
    conversations = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    met = every.join(repair(damaged(conversations)), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_SUMS, "cost")]
    return met.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
