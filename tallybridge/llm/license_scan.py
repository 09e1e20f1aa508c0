"""Licence scan by ordered signature rules, in DataFrame functions only.

A text that holds none of the anchor words is done. For the others each rule's keyword decides whether its pattern is tried at all; the places of
all matches follow from the pieces between them. Detections are sorted by place, and one pass keeps those that no stronger or equally strong detection
contains. The labels of plain phrases are found on word level and always stay.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .license_rules import ANCHORS, CONFIDENCE, GAP, Rule, rules
from .order_minhash import let

#: What separates words, after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words before "license", nearest first, and the label of the phrase.
PHRASES = [(("mit",), "mit"), (("apache",), "apache"), (("public", "general"), "gpl")]
_LEVELS = len(CONFIDENCE)
_SPAN = "struct<start:int,stop:int,priority:int,rule:int,label:string>"


def _words(lowered: Column) -> Column:
    """Words, with an empty string before or after them where the text begins or ends with a separator."""
    return F.split(lowered, _BETWEEN)


def _n_words(words: Column) -> Column:
    n = F.size(words)
    return n - (F.get(words, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(words, n - 1) == "")).cast("int")


def _phrase_places(words: Column) -> Column:
    """(start, label) of every phrase; start counts words from 0."""
    lead = (F.get(words, F.lit(0)) == "").cast("int")

    def label(i: Column) -> Column:
        cases = [(reduce(lambda a, b: a & b, (F.get(words, i - k - 1) == w for k, w in enumerate(before))), len(before), name) for before, name in PHRASES]
        return F.coalesce(*(F.when(hit, F.struct((i - n - lead).alias("start"), F.lit(name).alias("label"))) for hit, n, name in cases))

    ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == "license")
    return F.array_compact(F.transform(ends, label))


#: Items that a fold appends to one array before it begins another.
_CHUNK = 64


def _fold(items: Column, state: str, kind: str, step) -> Column:
    """All spans that ``step(state, item) -> (state, spans)`` gives in turn, beginning with the SQL value ``state`` of type ``kind``.

    An append copies its array, so items go by chunks: the work grows with their number, but for a small share (the square of it over the square of a chunk).
    """
    inner, outer = f"struct<state:{kind},out:array<{_SPAN}>>", f"struct<state:{kind},out:array<array<{_SPAN}>>>"

    def chunk(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out")).cast(inner)

        def one(a: Column, x: Column) -> Column:
            after, spans = step(a["state"], x)
            return F.struct(after.alias("state"), F.concat(a["out"], spans).alias("out")).cast(inner)

        return let(F.aggregate(part, begin, one), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")).cast(outer))

    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / _CHUNK).cast("int") - 1), lambda c: F.slice(items, c * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.expr(f"cast(struct({state} as state, array() as out) as {outer})")
    return F.when(F.size(items) == 0, F.expr(f"cast(array() as array<{_SPAN}>)")).otherwise(F.flatten(F.aggregate(chunks, none, chunk)["out"]))


def _matches(lowered: Column, rule: Column) -> Column:
    """Spans of all matches of a rule, in code points."""

    def spans(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            def step(at: Column, k: Column) -> tuple[Column, Column]:
                start = at + F.length(F.get(pieces, k))
                stop = start + F.length(F.get(found, k))
                return stop, F.array(F.struct(start.alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["number"].alias("rule"), rule["label"].alias("label")).cast(_SPAN))

            return _fold(F.sequence(F.lit(0), F.size(found) - 1), "0", "int", step)

        return F.when(F.size(found) == 0, F.expr(f"cast(array() as array<{_SPAN}>)")).otherwise(let(F.split(lowered, rule["pattern"], -1), walk))

    return let(F.regexp_extract_all(lowered, rule["pattern"], F.lit(0)), spans)


def _holds(lowered: Column, phrase: str) -> Column:
    """Whether the words of a phrase follow each other, with gaps as in the rules between them."""
    first, *rest = phrase.split(" ")
    held = F.contains(lowered, F.lit(first))
    return held & F.rlike(lowered, F.lit(phrase.replace(" ", GAP))) if rest else held


def _rule_table(known: list[Rule]) -> Column:
    quote = lambda s: "r'" + s + "'" if "'" not in s else 'r"' + s.replace(r'\"', '"').replace('"', r"\x22") + '"'
    return F.expr("array(" + ", ".join(f"named_struct('number', {r.number}, 'label', '{r.label}', 'priority', {r.priority}, 'keyword', {quote(r.keyword)}, 'pattern', {quote(r.pattern)})" for r in known) + ")")


def _detections(lowered: Column, known: list[Rule]) -> Column:
    tried = F.filter(_rule_table(known), lambda r: F.contains(lowered, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _matches(lowered, r)))
    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("before"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    back = F.transform(F.array_sort(order), lambda d: F.struct(d["start"].alias("start"), (-d["before"]).alias("stop"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")).cast(_SPAN))
    return back


def _unsuppressed(sorted_spans: Column) -> Column:
    """Detections that no earlier one of the same or a better priority contains. Sorted by start, then longest first, then priority and
    rule, so a container always comes before what it contains; the farthest end for each priority tells the rest."""
    def step(ends: Column, d: Column) -> tuple[Column, Column]:
        hidden = F.get(ends, d["priority"]) >= d["stop"]
        farther = F.transform(ends, lambda e, p: F.when(p >= d["priority"], F.greatest(e, d["stop"])).otherwise(e))
        return F.when(hidden, ends).otherwise(farther), F.when(hidden, F.expr(f"cast(array() as array<{_SPAN}>)")).otherwise(F.array(d))

    return _fold(sorted_spans, f"array({', '.join(['-1'] * _LEVELS)})", "array<int>", step)


def scan(docs: DataFrame, *, text: str = "text", known: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, places (start, label of base phrases), detections (start, stop, priority, rule, label; after suppression).

    A null text counts as empty: no words, no places, no detections. Texts are scanned whole; a row's result depends on its text alone.
    Rules that are given pass by their own keywords instead of the anchor words.
    Other columns pass through, those with the names of results are replaced.
    """
    anchors, known = (ANCHORS, rules()) if known is None else (sorted({r.keyword for r in known}), known)
    out = docs.drop("n_words", "places", "detections")
    low, parted = C.free_names(out, "lowered", "words")
    lowered = F.col(low)
    out = out.withColumn(low, F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase))
    out = out.withColumn(parted, _words(lowered))
    places = F.when(F.contains(lowered, F.lit("license")), _phrase_places(F.col(parted))).otherwise(F.expr("cast(array() as array<struct<start:int,label:string>>)"))
    gate = reduce(lambda a, b: a | b, (_holds(lowered, a) for a in anchors), F.lit(False))
    spans = F.when(gate, let(_detections(lowered, known), _unsuppressed)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    return out.withColumn("n_words", _n_words(F.col(parted)).cast("long")).withColumn("places", places).withColumn("detections", spans).drop(low, parted)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    s = scan(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    sure = F.array_min(F.col("detections.priority"))
    confidence = F.coalesce(F.get(F.array(*map(F.lit, CONFIDENCE)), sure), F.lit(0.0))
    return s.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).cast("long").alias("first_word"), F.array_max(F.col("places.start")).cast("long").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat(F.col("places.label"), F.col("detections.label"))).alias("labels"),
        F.greatest(confidence, F.when(F.size("places") > 0, CONFIDENCE[3]).otherwise(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
