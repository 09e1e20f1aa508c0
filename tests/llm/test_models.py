"""The language model against a plain one, and language identification by held-out accuracy."""

import collections
import math
import os
import random

import numpy as np
import pytest

from tallybridge.llm import language_id, lm_score
from tallybridge.llm import _common as C

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


class Plain:
    """An interpolated modified Kneser-Ney model in dictionaries, from the definitions."""

    def __init__(self, texts, order):
        rows = [["<s>"] * (order - 1) + tokens(t) for t in texts]
        self.order = order
        self.one = collections.Counter(w for t in texts for w in tokens(t))
        self.counts = {order: collections.Counter(tuple(r[i : i + order]) for r in rows for i in range(len(r) - order + 1))}
        for k in range(order - 1, 0, -1):  # a shorter gram counts the words seen before it
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.cuts, self.after = {}, {}
        for k, counts in self.counts.items():
            n = collections.Counter(counts.values())
            self.cuts[k] = [0.5] * 3
            if n[1] and n[2]:
                y = n[1] / (n[1] + 2 * n[2])
                raw = [j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 1.5 for j in (1, 2, 3)]
                self.cuts[k] = [min(max(x, 0.05), j + 0.95) for j, x in enumerate(raw)]
            self.after[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
            for g, c in counts.items():
                self.after[k][g[:-1]][0] += c
                self.after[k][g[:-1]][min(c, 3)] += 1
        self.size, self.n = len(self.one), sum(self.one.values())

    def p(self, context, word):
        """Of a word after at least ``order - 1`` words."""
        out = 1 / (self.size + 1)
        for k in range(1, self.order + 1):
            gram = (*context[len(context) - k + 1 :], word)
            if gram[:-1] in self.after[k]:
                total, *kinds = self.after[k][gram[:-1]]
                c = self.counts[k].get(gram, 0)
                cut = self.cuts[k][min(c, 3) - 1] if c else 0
                out = (c - cut) / total + sum(d * n for d, n in zip(self.cuts[k], kinds)) / total * out
        return out

    def score(self, text):
        r = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(r[:i]), r[i])) for i in range(self.order - 1, len(r)))


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(40)] + ["é", "ABC", "x,y"]
    return [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order,flush", [(2, None), (2, 50), (3, None), (3, 50), (4, 200)])
def test_scores_equal_a_plain_model(spark, monkeypatch, order, flush):
    if flush:
        monkeypatch.setattr(lm_score, "FLUSH", flush)
        monkeypatch.setattr(lm_score, "PART_TOKENS", 300)
    learned = [None, "", "w1 w2 w1 " * 300, *texts(120, 1)]
    asked = learned[:30] + texts(20, 2) + ["unknown words only", "W1\tW2\nW1 new"]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(learned)], "doc_id long, text string").repartition(3)
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(asked)] + [(None, "W1", 0)], "doc_id long, text string, score int")
    plain = Plain(learned, order)
    got = lm_score.score(docs, lm_score.train(train, order=order)).collect()
    assert len(got) == len(asked) + 1
    for r in got:
        t = asked[r.doc_id] if r.doc_id is not None else "W1"
        assert r.score == pytest.approx(plain.score(t), abs=1e-8)
        assert r.n_tokens == len(tokens(t)) and r.n_known == sum(w in plain.one for w in tokens(t)) and r.train_tokens == plain.n
        assert r.base_score == pytest.approx(sum(math.log10((plain.one[w] + 1) / (plain.n + plain.size + 1)) for w in tokens(t)))


def test_probabilities_sum_to_one():
    for order in (2, 3, 4):
        plain = Plain(texts(60, 3), order)
        for context in [("<s>",) * 3, (b"w0", b"w1", b"w0"), (b"w5", b"w5", b"w5"), (b"none",) * 3]:
            assert sum(plain.p(context, w) for w in plain.one) + plain.p(context, "unknown") == pytest.approx(1)


def test_large_counts_and_hot_contexts(tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "LARGE", 5)
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 1000, dtype=np.uint64))
    counts = rng.choice(np.array([1, 2, 3, 254, 255, 256, 1 << 40], np.uint64), len(keys))
    np.save(tmp_path / "x.key.npy", keys)
    lm_score._save_counts(str(tmp_path / "x"), counts)
    table = lm_score._Table(str(tmp_path / "x"))
    absent = np.setdiff1d(keys + np.uint64(1), keys)
    assert (table.find(keys) == counts.astype(np.int64)).all() and not table.find(absent).any()
    low = np.arange(0, 900, 9)
    high = low + rng.integers(0, 9, len(low))
    for _ in range(2):
        for k, (a, b) in enumerate(zip(low, high)):
            c = counts[a:b].astype(np.int64)
            assert table.ranges(low, high)[:, k].tolist() == [c.sum(), (c == 1).sum(), (c == 2).sum(), (c > 2).sum()]


def test_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_score.score(docs, lm_score.train(empty)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)
    assert lm_score.score(empty, lm_score.train(docs)).count() == 0


def test_keys_survive_pressing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (lm_score.unpress_keys(lm_score.press_keys(keys)) == keys).all()


def test_word_hashes():
    data = np.frombuffer("Ab c\nab\x1cd".encode() + b"C" + b"  " + b"AB", np.uint8)
    h, row = C.words_of(data, np.array([0, 2, 9, 9, 12, 14]))
    assert row.tolist() == [0, 1, 1, 3, 4] and h[0] == h[4] and h[1] == h[3] != h[0]


def test_language_rows(spark):
    rng = random.Random(2)
    said = {"xx": ["aba", "abab", "baab"], "yy": ["óñó", "ñoñó", "oóñ"]}
    rows = [(k, " ".join(rng.choices(said[lang], k=20)), lang) for k in range(200) for lang in [rng.choice(["xx", "yy"])]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "", None), (902, "12 -- 7", "yy"), (None, "aba aba", None), (903, "аб", None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = language_id.fit(docs, language_id.remainder("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and got[None].lang_pred == "xx"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and got[k].rejected for k in (900, 901, 902))
    assert got[903].lang_pred in said and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.fit(docs.limit(0), language_id.remainder("doc_id", 4) != 2)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"} and language_id.identify(docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    got = language_id.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.rejected.mean() < 0.02


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_model_beats_the_base_on_held_out_text(spark):
    got = lm_score.op4_lm_score(spark, SF).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()
