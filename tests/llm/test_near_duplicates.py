"""SimHash and embedding near-duplicates, components, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallybridge.llm import _common as C
from tallybridge.llm import embedding_dedup, simhash


def plain_components(n, links):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in links:
            m = min(label[i], label[j])
            moved |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return label


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 60
    links = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "none": []}[shape]
    got = {r.id: r.component for r in C.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = plain_components(n, links)
    assert got == {i: label[i] for i in range(n) if any(i in x and x[0] != x[1] for x in links)}


def test_simhash_of_a_text():
    text = "The quick É Brown\tfox\njumps over the quick é brown"
    words = ["the", "quick", "É", "brown", "fox", "jumps", "over", "the", "quick", "é", "brown"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(9)]
    assert simhash.simhash(simhash.shingle_hashes(text)) == sum((2 * sum(x >> b & 1 for x in h) > 9) << b for b in range(64))
    assert simhash.simhash(simhash.shingle_hashes("One two")) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.simhash(simhash.shingle_hashes(" \n")) == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for k in range(250):
        v[k + 250] = v[k % 41] ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 8)))))
    ends = np.full(500, 500)
    ends[:130] = 130
    got = set()
    for i, j in simhash._close_pairs(v, np.arange(1, 501), ends, np.arange(500), radius):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == {(i, j) for i in range(500) for j in range(i + 1, ends[i]) if (int(v[i]) ^ int(v[j])).bit_count() <= radius}


@pytest.mark.parametrize("blocks", [None, 6])
def test_near_duplicate_documents(spark, monkeypatch, blocks):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(200)) for _ in range(12)]
    texts = [None, "", " ", "one two", *base, *base[:3]]
    for _ in range(60):
        words = rng.choice(base[:4]).split()
        words[rng.randrange(200)] = "changed"
        texts.append(" ".join(words))
    rows = [(k * 3, t, "x") for k, t in enumerate(texts)] + [(None, base[0], "x"), (0, None, "x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs, blocks=blocks).collect()
    assert len(got) == len(rows)
    fp = {k: simhash.simhash(simhash.shingle_hashes(t or "")) for k, t, _ in rows if k is not None}
    ids = sorted(fp)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 3]
    label = plain_components(len(ids), links)
    of = {ids[i]: ids[label[i]] for i in range(len(ids))}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == of
    same = {fp[k]: of[k] for k in ids}
    assert [r.component_id for r in got if r.doc_id is None] == [same[simhash.simhash(simhash.shingle_hashes(base[0]))]]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_through_rows_without_an_id(spark):
    """Texts of which each is within three bits of the next, the ends further apart; the middle one has no id."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    prints = {}
    while True:
        base = [rng.choice(words) for _ in range(120)]
        chain = [base]
        for _ in range(2):
            changed = list(chain[-1])
            changed[rng.randrange(120)] = rng.choice(words)
            chain.append(changed)
        texts = [" ".join(x) for x in chain]
        prints = [simhash.simhash(simhash.shingle_hashes(t)) for t in texts]
        near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
        if near(0, 1) and near(1, 2) and not near(0, 2):
            break
    rows = [(5, texts[0]), (None, texts[1]), (9, texts[2]), (None, "alone and far away"), (None, "alone and far away")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (None, 5), (9, 5), (None, None)}
    assert len(got) == 5 and sum(r.component_id is None for r in got) == 2


def test_similar_documents(spark):
    """All pairs by brute force: those at a Jaccard similarity of 0.8 or more meet, and nothing below 0.55 is linked."""
    rng = random.Random(11)
    texts = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 260))]
        for c in range(4):
            words = list(base)
            for at in rng.sample(range(len(base)), c * len(base) // 100):
                words[at] = "changed"
            texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 80))) for _ in range(200)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j]}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=5, similarity=0.8).collect()}
    close = [p for p, s in alike.items() if s >= 0.8]
    assert len(close) > 100 and sum(got[i] == got[j] for i, j in close) >= 0.98 * len(close)
    loose = plain_components(len(texts), [p for p, s in alike.items() if s >= 0.55])
    assert all(loose[i] == loose[got[i]] for i in got)


@pytest.mark.parametrize("cut", [None, 8])
def test_few_shingles_are_compared_exactly(spark, monkeypatch, cut):
    """Short texts, some of frequent passages: exactly the pairs at 0.8 or more are linked, 4 of 5 shingles shared among them."""
    if cut:
        monkeypatch.setattr(simhash, "SLICE", cut)
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(9))
    texts = [None, "", " \n", "one", "one", "two words", "a b c d", "a b c d e f g h", "a b c d e f g h i"]
    for g in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 36))]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            edit = rng.randrange(4)
            if edit == 0:
                other.append(f"x{rng.randrange(99)}")
            elif edit == 1:
                del other[0]
            else:
                other[rng.choice([0, -1, len(other) // 2])] = f"y{rng.randrange(99)}"
            texts.append(" ".join(other))
    texts += [f"{passage} v{k} {' '.join(f'u{rng.randrange(40)}' for _ in range(k % 3))}" for k in range(60)]
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for t in texts]
    assert max(map(len, sets)) <= simhash.FEW + 1
    short = [k for k, s in enumerate(sets) if len(s) <= simhash.FEW]
    texts, sets = [texts[k] for k in short], [sets[k] for k in short]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert any(len(sets[i]) + len(sets[j]) == 9 and len(sets[i] & sets[j]) == 4 for i, j in links)
    label = plain_components(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, size=5, similarity=0.8).collect()}
    assert got == {k: label[k] for k in range(len(texts))}
    assert simhash.near_duplicates(docs.limit(0), size=5, similarity=0.8).count() == 0


def test_large_buckets_are_shared(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 16)
    held = []
    monkeypatch.setattr(C, "tiles", lambda *a, tiles=C.tiles: held.append(tiles(*a)) or held[-1])
    rng = random.Random(6)
    values = [sum(1 << b for b in rng.sample(range(16, 64), 4)) for _ in range(120)]
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(dict.fromkeys(values))], "fp long, rep long")
    values = list(dict.fromkeys(values))
    got = {r.id: r.component for r in C.connected_components(simhash.close_links(classes)).collect()}
    label = plain_components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    assert all(got.get(i, i) == label[i] for i in range(len(values)))
    groups = held[0].groupBy("block", "key", "low", "high").agg(F.count("*").alias("n"), F.count_distinct("own").alias("slices")).collect()
    assert max(r.high for r in groups) >= 6 and max(r.n for r in groups) < 4 * 16 and max(r.slices for r in groups) == 2


def test_blocks_follow_the_count():
    assert [simhash.blocks_for(n, 3) for n in (10, 10**6, 10**8, 10**11)] == [4, 4, 5, 6]


def test_groups_come_whole():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 500))
    table = pa.table({"k": key, "v": np.arange(500)})
    for rows in (1, 30, 1000):
        parts = list(C.whole_groups(iter(table.to_batches(max_chunksize=7)), ["k"], rows))
        assert pa.concat_tables(parts).column("v").to_pylist() == list(range(500))
        assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(parts, parts[1:])) and (rows > 500 or len(parts) > 5)


@pytest.mark.parametrize("small", [False, True])
def test_embedding_links(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(embedding_dedup, "SLICE", 8)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    x = [*rng.normal(size=(60, 16)), *(centres[k % 20] + 0.12 * rng.normal(size=16) for k in range(80))]
    rows = [(k * 2, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)]
    rows += [(1000, rows[70][1]), (1002, [2 * v for v in rows[70][1]]), (1004, None), (1006, []), (1008, [0.0] * 16), (1010, [float("nan")] * 16), (1012, [1.0] * 15 + [None]), (1014, [float("inf")] * 16), (1016, [1.0, 2.0]), (1018, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(a, np.array(b) / np.linalg.norm(b)) for a, b in rows if b and None not in b and np.isfinite(b).all() and any(b)]
    links = [(i, j) for i in range(len(good)) for j in range(i) if len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.95]
    degree = np.bincount(np.array(links).ravel(), minlength=len(good))
    found = sum(got[a].n_links for a, _ in good)
    assert all(got[a].n_links <= degree[i] for i, (a, _) in enumerate(good)) and found >= 0.98 * degree.sum()
    if found == degree.sum():
        label = plain_components(len(good), links)
        assert all(got[a].component_id == good[label[i]][0] for i, (a, _) in enumerate(good))
    for a in (1004, 1006, 1008, 1010, 1012, 1014):
        assert (got[a].n_links, got[a].component_id) == (0, a)
    assert got[1018].component_id == 1016
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_an_id(spark):
    """Rows without an id count and link; a component without any id has none."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0], [0.0, 0.0, 0.0, 1e-30]
    rows = [(None, a), (None, a), (7, b), (5, b), (None, c), (None, None), (9, [0.0, 1e30, 0.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 3, 5), (None, 3, 5), (7, 3, 5), (5, 3, 5), (None, 0, None), (None, 0, None), (9, 0, 9)], key=str)


def test_more_vectors_make_narrower_buckets():
    plans = [embedding_dedup.plan(n, 0.95) for n in (10, 10**4, 10**6, 10**9)]
    assert [p[0] for p in plans] == sorted(p[0] for p in plans) and [p[1] for p in plans] == sorted(p[1] for p in plans)


def test_repeated_ids_keep_unrelated_texts(spark):
    """Rows of one id are told apart by their texts: each unrelated text stays, and no group goes with another's row."""
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(3))
    near = a + " more"
    rows = [(1, a), (1, b), (1, b), (2, near), (3, b), (0, b + " end"), (4, c), (4, None), (4, ""), (None, c)]
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    told = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got)
    assert told == sorted([(1, a), (0, b + " end"), (4, c), (4, "")])
