"""Cleaning, folding and similarity against plain versions and published examples."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybridge.functions import cleaning, folding, similarity
from tallybridge.functions import vocab as V


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def test_clean_name(spark):
    texts = [None, "", " 顺丰（集团） 有限公司", "ab​c\U000e0001d", "Ａｂ－１、x", "１２３", "straße", "a\tb"]
    got = values(spark, texts, cleaning.clean_name(F.col("t")))
    assert [g[0] for g in got] == ["", "", "顺丰(集团)有限公司", "ABCD", "AB-1,X", "123", "STRASSE", "AB"]


def test_invisible_class_covers_format_and_control_characters(spark):
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cc" or any(a <= c <= b for a, b in V.INVISIBLE)]
    (got,) = values(spark, ["".join(map(chr, points)) + "1e"], cleaning.strip_invisible(F.col("t")))
    assert got[0] == "1e"


def test_parens_and_punctuation(spark):
    got = values(spark, ["a(b)c", "a((b)c)d", "a.b·c，d", "()"], cleaning.strip_parens(F.col("t")), cleaning.strip_punct(F.col("t")))
    assert got == [("ac", "abc"), ("a(c)d", "abcd"), ("a.b·c，d", "abcd"), ("", "")]


def test_lenient_number(spark):
    got = values(spark, ["1,234.5", " 7 ", "x", None, "", "1e3"], cleaning.lenient_number(F.col("t")))
    assert [g[0] for g in got] == [1234.5, 7.0, 0.0, 0.0, 0.0, 1000.0]


def strip_tail(text, words):
    words = sorted(words, key=len, reverse=True)
    while (w := next((w for w in words if text.endswith(w) and len(text) > len(w)), None)) is not None:
        text = text[: -len(w)]
    return "" if text in V.REGIONS or text in V.GENERIC else text


def test_folding_matches_a_plain_loop(spark):
    rng = random.Random(4)
    parts = [*V.GENERIC, *V.INDUSTRIES, *V.REGIONS, "顺", "丰", "哔哩"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(400)] + ["顺丰" + "科技" * 20, "顺" + "厂" * 40 + "控股" * 25, "店" * 30]
    fold = folding.collapse_generic(F.col("t"))
    got = values(spark, texts, fold, folding.collapse_industry(fold))
    for t, (a, b) in zip(texts, got):
        assert a == strip_tail(t, V.GENERIC)
        assert b == (strip_tail(a, V.INDUSTRIES) if a else "")


def test_protected_and_examples(spark):
    names = ["中国建设银行股份有限公司", "中国银行股份有限公司", "顺丰控股股份有限公司", "上海哔哩哔哩科技有限公司"]
    clean = cleaning.clean_name(F.col("t"))
    fold = folding.collapse_generic(clean)
    got = values(spark, names, folding.protected_in(clean), fold, folding.collapse_industry(fold))
    assert got[0][0] == "建设" and got[1] == ("", "", "") and got[2][1:] == ("顺丰控股", "顺丰")
    assert got[3][1] == "上海哔哩哔哩"  # a region before the name stays


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(one_way(a, b), one_way(b, a))
    return one_way(*sorted((a, b), key=len))


def one_way(s, t):
    m = len(s)
    return max(plain_ratio(s, w) for w in {t[:i] for i in range(1, m)} | {t[i : i + m] for i in range(len(t))})


text = st.text(st.sampled_from("ab中国\U0001f600"), max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=8))
def test_ratios_match_plain_versions(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert similarity.ratio(a, b) == pytest.approx([plain_ratio(x, y) for x, y in pairs])
    assert similarity.partial_ratio(a, b) == pytest.approx([plain_partial(x, y) for x, y in pairs])
    assert similarity.ratio(b, a) == pytest.approx(similarity.ratio(a, b))


def test_ratios_of_long_texts():
    rng = random.Random(2)
    a = ["".join(rng.choice("abc") for _ in range(n)) for n in (63, 64, 65, 90)]
    b = ["".join(rng.choice("abc") for _ in range(n)) for n in (64, 64, 66, 70)]
    assert similarity.ratio(a, b) == pytest.approx([plain_ratio(x, y) for x, y in zip(a, b)])
    assert similarity.partial_ratio(a, b) == pytest.approx([plain_partial(x, y) for x, y in zip(a, b)])


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, pairs = list(range(len(b))), []
    for i, c in enumerate(a):
        j = next((j for j in free if b[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            free.remove(j)
            pairs.append(j)
    if not pairs:
        return 0.0
    m = len(pairs)
    hit = [b[j] for j in pairs]
    moved = sum(x != y for x, y in zip(hit, [b[j] for j in sorted(pairs)])) // 2
    s = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return 100 * (s + start * 0.1 * (1 - s) if s > 0.7 else s)


def test_jaro_winkler():
    got = similarity.jaro_winkler(["MARTHA", "DIXON", "中国石油", "", ""], ["MARHTA", "DICKSONX", "中国石化", "a", ""])
    assert got.tolist() == pytest.approx([96.1111, 81.3333, 88.3333, 0, 100], abs=1e-3)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=8))
def test_jaro_winkler_matches_a_plain_version(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert similarity.jaro_winkler(a, b).tolist() == pytest.approx([plain_jaro_winkler(x, y) for x, y in pairs])


def plain_factor(a, b):
    """By regular expression and slices of all splits: the longest common start, then the longest common end of what is left."""
    import os.path

    if not a or not b:
        return 1.0
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:][::-1], b[start:][::-1]
    end = len(os.path.commonprefix([a, b]))
    short, long = sorted((a[end:][::-1], b[end:][::-1]), key=len)
    if not short:
        return {0: 1.0, 1: 1.0, 2: 0.55}.get(len(long), 0.40)
    if len(long) == 1 or (len(short) < 3 and short in long):
        return 1.0
    r = plain_ratio(short, long)
    return 1.0 if r >= 70 else 0.9 if r >= 45 else 0.5


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(text, text, text, text), min_size=1, max_size=8))
def test_penalties_match_a_plain_version(parts):
    a, b = [p + x + q for p, x, _, q in parts], [p + y + q for p, _, y, q in parts]
    bare_a, bare_b = [x.replace("b", "") for x in a], [x.replace("b", "") for x in b]
    want = [1.0 if c == d else min(plain_factor(x, y), plain_factor(c, d)) for x, y, c, d in zip(a, b, bare_a, bare_b)]
    assert similarity.divergence_penalty(a, b, bare_a, bare_b).tolist() == want


def test_penalties_of_long_texts():
    rng = random.Random(6)
    a = ["x" + "".join(rng.choice("abcd") for _ in range(n)) + "y" for n in (63, 64, 65, 150)]
    b = ["x" + "".join(rng.choice("abcd") for _ in range(n)) + "y" for n in (64, 64, 80, 140)]
    assert similarity.divergence_penalty(a, b, a, b).tolist() == [plain_factor(x, y) for x, y in zip(a, b)]


def test_penalties():
    pairs = [
        ("北京字节跳动网络技术有限公司", "北京字跳网络技术有限公司", 1.0), ("云南白药集团股份有限公司", "云南白药集团股份有线公司", 1.0), ("中国建设银行股份有限公司", "中国银行股份有限公司", 0.55),
        ("安永华明会计师事务所(特殊普通合伙)", "大华会计师事务所(特殊普通合伙)", 0.50), ("中国石油天然气股份有限公司", "中国石油化工股份有限公司", 0.50), ("中国平安保险(集团)股份有限公司", "中国平安保险(集团)", 0.40),
        ("安永华明会计师事务所(特殊普通合伙)", "安永华明会计师事务所(北京分所)", 1.0),
    ]
    import re

    bare = lambda x: re.sub(r"\([^()]*\)", "", x)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert similarity.divergence_penalty(a, b, list(map(bare, a)), list(map(bare, b))).tolist() == [p[2] for p in pairs]


def test_unicode_report(spark):
    (got,) = values(spark, [" 中a​1"], cleaning.unicode_report(F.col("t")))
    r = got[0]
    assert (r.length, r.codepoints, r.surrounded, r.non_ascii, r.categories) == (5, "U+0020 U+4E2D U+0061 U+200B U+0031", True, True, "ZLLCN")
    assert [(x.place, x.point, x.meaning) for x in r.invisibles] == [(0, "U+0020", ""), (3, "U+200B", "ZERO WIDTH SPACE 零宽空格")]
