"""Controlled tags that explain a pair, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cleaning, folding, similarity
from ..functions import vocab as V

NO_TAGS = "cast(array() as array<struct<tag:string,detail:string>>)"


def _tag(name: str, detail: Column | str = "") -> Column:
    assert name in V.TAGS, name
    return F.array(F.struct(F.lit(name).alias("tag"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def _if(condition: Column, tags: Column) -> Column:
    return F.when(condition, tags).otherwise(F.expr(NO_TAGS))


def cores(a: Column, b: Column) -> tuple[Column, Column]:
    """What is left of two strings without their common prefix and, after it, their common suffix; empty for equal or empty strings."""
    n = F.least(F.length(a), F.length(b))
    up_to = lambda m: F.sequence(F.lit(0), m)
    prefix = F.array_max(F.filter(up_to(n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    suffix = F.array_max(F.filter(up_to(n - prefix), lambda i: F.right(a, i) == F.right(b, i)))
    out = lambda x: F.when((a == "") | (b == "") | (a == b), F.lit("")).otherwise(F.substring(x, prefix + 1, F.length(x) - prefix - suffix))
    return out(a), out(b)


def _has_any(c: Column, words: list[str]) -> Column:
    return c.rlike(cleaning.quoted(words))


def _extra_tag(extra: Column, who: str) -> Column:
    detail = F.concat(F.lit(f"{who}多出「"), extra, F.lit("」"))
    return (
        F.when(extra == "", _tag("字号一致", detail))
        .when(_has_any(extra, V.BRANCHES), _tag("包含关系（附加分支机构）", detail))
        .when(_has_any(extra, V.ORGANISATIONS), _tag("包含关系（丢弃公司后缀）", detail))
        .when(_has_any(extra, V.EXPLAINED_REGIONS), _tag("包含关系（附加地区）", detail))
        .otherwise(_tag("包含关系（简称 vs 全称）", detail))
    )


def _without_first(long: Column, short: Column) -> Column:
    at = F.instr(long, short)
    return F.concat(F.substring(long, F.lit(1), at - 1), F.substring(long, at + F.length(short), F.length(long)))


def _folded(a: Column, b: Column) -> Column:
    return F.struct(folding.protected_in(a).alias("pa"), folding.protected_in(b).alias("pb"), folding.collapse_generic(a).alias("fa"), folding.collapse_generic(b).alias("fb"))


def _core_tags(core: Column, notes_differ: Column) -> Column:
    ca, cb = core["ca"], core["cb"]
    shown = lambda c: F.when(c == "", "（无）").otherwise(c)
    between = F.concat(F.lit("「"), shown(ca), F.lit("」vs「"), shown(cb), F.lit("」"))
    typo = F.when((ca == "") | (cb == ""), F.greatest(F.length(ca), F.length(cb)) <= 1).otherwise((F.levenshtein(ca, cb) == 1) | (F.least(F.length(ca), F.length(cb)) <= 1))
    return _if((ca != "") | (cb != ""), F.concat(F.when(typo, _tag("疑似错别字", between)).otherwise(_tag("字号不同", between)), _if(notes_differ, _tag("括号内信息不同"))))


def _name_tags(raw: Column, clean: Column, folded: Column) -> Column:
    """Tags of two names as they are, cleaned and folded."""
    raw_a, raw_b, a, b = raw["a"], raw["b"], clean["a"], clean["b"]
    half = lambda c: F.translate(c, "（）", "()")
    invisible = cleaning.has_invisible(raw_a) | cleaning.has_invisible(raw_b)
    spaced = raw_a.rlike(r"(?U)\s") | raw_b.rlike(r"(?U)\s")
    latin = lambda c: c.rlike("[A-Za-z]")
    cleaning_tags = F.concat(
        _if(half(raw_a) == half(raw_b), _tag("括号全/半角差异")),
        F.when(invisible, _tag("不可见字符")).when(spaced, _tag("多余空格")).otherwise(F.expr(NO_TAGS)),
        _if((F.upper(raw_a) != raw_a) | (F.upper(raw_b) != raw_b), _tag("英文大小写差异")),
        _if(latin(a) != latin(b), _tag("含中英文字符", "一侧含英文，另一侧不含")),
    )
    pa, pb, fa, fb = (folded[k] for k in ("pa", "pb", "fa", "fb"))
    only = lambda x, y: F.array_except(F.split(x, ","), F.split(y, ","))
    differ = F.array_join(F.array_sort(F.filter(F.array_union(only(pa, pb), only(pb, pa)), lambda w: w != "")), "、")
    conflict = _tag("关键字号冲突", F.concat(F.lit("「"), differ, F.lit("」仅一方含有")))
    brackets = lambda c: F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    notes_differ = brackets(a) != brackets(b)
    same_fold = F.concat(_tag("同一字号（通用词差异）", F.concat(F.lit("「"), fa, F.lit("」"))), _if(notes_differ, _tag("括号附注不同")))
    ca, cb = cores(a, b)
    core_tags = cleaning.once(F.struct(ca.alias("ca"), cb.alias("cb")), lambda core: _core_tags(core, notes_differ))
    contained = F.contains(b, a) | F.contains(a, b)
    relation = F.when(F.contains(b, a), _extra_tag(_without_first(b, a), "B")).when(F.contains(a, b), _extra_tag(_without_first(a, b), "A")).otherwise(core_tags)
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0))
    gap = F.abs(F.length(a) - F.length(b))
    rest = F.concat(
        relation, _if(digits(a) != digits(b), _tag("数字不同")),
        _if(~contained & (gap >= 4), _tag("长度差异", F.concat(F.length(a).cast("string"), F.lit("字 vs "), F.length(b).cast("string"), F.lit("字")))),
    )
    beyond = F.when(pa != pb, conflict).when((fa != "") & (fa == fb), same_fold).otherwise(rest)
    return F.when(raw_a == raw_b, _tag("名称完全一致")).otherwise(F.concat(cleaning_tags, F.when(a == b, _tag("清洗后一致")).otherwise(beyond)))


def explain(raw_a: Column, raw_b: Column, *, score: Column | None = None, displaced: Column | None = None, mutual: Column | None = None, low: float = 70.0, floor: float = 60.0) -> Column:
    """array<struct<tag, detail>> for a pair of raw names; runtime tags where ``score``, ``displaced`` and ``mutual`` are given."""
    # what tags share is computed once for a row
    cleaned = lambda raw: F.struct(cleaning.clean_name(raw["a"]).alias("a"), cleaning.clean_name(raw["b"]).alias("b"))
    told = lambda raw, clean: cleaning.once(_folded(clean["a"], clean["b"]), lambda folded: _name_tags(raw, clean, folded))
    tags = cleaning.once(F.struct(raw_a.alias("a"), raw_b.alias("b")), lambda raw: cleaning.once(cleaned(raw), lambda clean: told(raw, clean)))
    if displaced is not None:
        elsewhere = _if(~mutual, _tag("非互为最优", "建议复核")) if mutual is not None else F.expr(NO_TAGS)
        tags = F.concat(tags, F.when(displaced, _tag("已让位（首选被更高分记录认领）")).otherwise(elsewhere))
    if score is not None:
        tags = F.concat(tags, _if((score >= floor) & (score < low), _tag("低置信度（建议逐条核实）")))
    return tags


def explain_text(tags: Column, sep: str = "；", limit: int = 5) -> Column:
    """Tags as one text, the first ``limit`` of them."""
    one = lambda t: F.when(t["detail"] != "", F.concat(t["tag"], F.lit("（"), t["detail"], F.lit("）"))).otherwise(t["tag"])
    text = F.array_join(F.transform(F.slice(tags, 1, limit), one), sep)
    return F.when(F.size(tags) > limit, F.concat(text, F.lit(f"{sep}…（共"), F.size(tags).cast("string"), F.lit("项）"))).otherwise(text)


def differences(raw_a: Column, raw_b: Column) -> Column:
    """array<string>: how two raw names differ, for the console: first in how they are written, then, where cleaning leaves a difference, in what they say."""
    d = V.DIFFERENCES
    a, b = cleaning.clean_name(raw_a), cleaning.clean_name(raw_b)
    bare = cleaning.strip_parens
    told = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    none = F.expr("cast(array() as array<string>)")
    if_ = lambda condition, reasons: F.when(condition, reasons).otherwise(none)
    half = lambda c: F.translate(c, "（）", "()")
    spaced = raw_a.rlike(r"(?U)\s") | raw_b.rlike(r"(?U)\s")
    written = F.concat(
        if_(half(raw_a) == half(raw_b), told(d["brackets"])),
        F.when(cleaning.has_invisible(raw_a) | cleaning.has_invisible(raw_b), told(d["invisible"])).when(spaced, told(d["spaces"])).otherwise(none),
        if_((F.upper(raw_a) != raw_a) | (F.upper(raw_b) != raw_b), told(d["case"])),
    )
    ca, cb = cores(a, b)
    penalty = similarity.penalty_factor(a, b, bare(a), bare(b))
    either = lambda c: F.when(c == "", d["none"]).otherwise(c)
    between = lambda show: [F.lit("「"), show(ca), F.lit("」vs「"), show(cb), F.lit("」")]
    notes = lambda c: F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    trade = F.when(penalty <= V.PENALTY_TWO, told(d["other"], *between(either))).when(penalty < 1, told(d["near"], *between(lambda c: c))).otherwise(none)
    said = F.concat(trade, if_(notes(a) != notes(b), told(d["notes"])))
    n = F.least(F.length(a), F.length(b))
    same_start = F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    before, after = d["from"].split("{}")
    said = F.when((F.size(said) == 0) & (F.size(written) == 0), told(before, (same_start + 1).cast("string"), after, *between(either))).otherwise(said)
    added = lambda text, long, short: told(text, "「", _without_first(long, short), "」")
    relation = F.when(F.contains(b, a), added(d["added_b"], b, a)).when(F.contains(a, b), added(d["added_a"], a, b)).otherwise(said)
    x, y, z = d["length"].split("{}")
    length = if_(F.abs(F.length(a) - F.length(b)) >= 2, told(x, F.length(a).cast("string"), y, F.length(b).cast("string"), z))
    or_else = lambda reasons, text: F.when(F.size(reasons) == 0, told(text)).otherwise(reasons)
    return F.when(raw_a == raw_b, told(d["same"])).when(a == b, or_else(written, d["clean"])).otherwise(or_else(F.concat(written, relation, length), d["unknown"]))
