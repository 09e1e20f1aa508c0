"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte n-grams of 2 to 4 within words, word edges included, are hashed to rows of an embedding table; a text is the mean of its rows. The
table and the softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents. A temperature
fitted on a part of the sample that training leaves out calibrates the scores, and with it the score below which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

#: Labelled documents that training takes of each language, on average; they are drawn by a hash of their ids.
SAMPLE_PER_LANGUAGE = 400
BITS, DIM, EPOCHS = 16, 16, 6
#: Texts scored at a time; their arrays then fit a core's cache.
CACHED_BYTES = 1 << 17
#: Share of correctly labelled calibration documents that the rejection threshold may lose at most, and its upper bound.
REJECT_SHARE, REJECT_MOST = 0.002, 0.4
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_MANY = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35]


@dataclass(frozen=True)
class Model:
    labels: list[str]
    table: np.ndarray  # (2**BITS + 1, width): what a gram adds; the last row, zero, is for no gram
    weights: np.ndarray  # (width, labels)
    bias: np.ndarray
    temperature: float
    reject_below: float


def grams(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For n of 2, 3, 4 the table row of the n-gram at every byte; 2**BITS where none starts.

    Only letters count; what is not a letter is an edge. An edge may be a gram's first or last byte, and no gram leaves its text.
    """
    n = len(data)
    b = _FOLD[data]
    edge = b == 32
    text = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    key, inner, out = b.copy(), np.ones(n, bool), []
    for size in (2, 3, 4):
        m = max(0, n - size + 1)
        key = key[:m] | (b[size - 1 :] << np.uint32(8 * (size - 1)))
        ok = text[:m] == text[size - 1 :]
        if size == 2:
            ok &= ~(edge[:m] & edge[1:])
        else:
            inner = inner[:m] & ~edge[size - 2 : size - 2 + m]
            ok &= inner
        row = np.full(n, 1 << BITS, np.int32)
        with np.errstate(over="ignore"):
            row[:m][ok] = ((key[ok] * np.uint32(_MANY[size - 2])) ^ (key[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
        out.append(row)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """A model of these texts; every fifth is left out of training for calibration where there are enough."""
    labels = sorted(set(languages))
    y = np.array([labels.index(x) for x in languages])
    features = []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        rows = np.concatenate(grams(data, np.array([0, len(data)]))) if len(data) else np.zeros(0, np.int32)
        rows, count = np.unique(rows[rows < 1 << BITS], return_counts=True)
        features.append((rows, (count / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    ids = rng.permutation(len(texts))
    held = ids[::5] if len(ids) >= 20 else ids
    fit = np.setdiff1d(ids, held) if len(ids) >= 20 else ids
    e = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 1, DIM)).astype(np.float32)
    e[-1] = 0
    u, bias = rng.normal(0, 0.1, (DIM, len(labels))), np.zeros(len(labels))
    steps = EPOCHS * len(fit)
    done = 0
    for _ in range(EPOCHS):
        for d in rng.permutation(fit):
            rows, w = features[d]
            h = w @ e[rows]
            p = _softmax((h @ u + bias)[None])[0]
            p[y[d]] -= 1
            rate = 0.5 * (1 - done / steps)
            back = (u @ p).astype(np.float32)
            u -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            if len(rows):
                e[rows] -= (rate / float(w @ w)) * 0.2 * w[:, None] * back
            done += 1
    z = np.array([features[d][1] @ e[features[d][0]] @ u + bias for d in held]).reshape(len(held), len(labels))
    warm = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in warm]
    temperature = float(warm[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    below = min(REJECT_MOST, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    if len(labels) <= DIM:  # a gram's share of the logits; else its embedding
        return Model(labels, (e @ u).astype(np.float32), np.eye(len(labels)), bias, temperature, below)
    return Model(labels, e, u, bias, temperature, below)


def predict(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, one row per text."""
    rows = grams(data, off)
    n = np.diff(np.concatenate([[0], np.cumsum(sum((r < 1 << BITS).astype(np.int64) for r in rows))])[off])
    mean = np.empty((len(off) - 1, model.table.shape[1]))
    for k in range(model.table.shape[1]):
        t = np.ascontiguousarray(model.table[:, k])
        run = np.concatenate([[0.0], np.cumsum(t[rows[0]] + t[rows[1]] + t[rows[2]], dtype=np.float64)])
        mean[:, k] = np.diff(run[off]) / np.maximum(n, 1)
    return _softmax((mean @ model.weights + model.bias) / model.temperature)


def has_letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    found = np.diff(ascii_letters[off]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace")))
    return found


def _predictor(model):
    def run(batches):
        m: Model = model.value
        names = np.array([*m.labels, UNDETERMINED], object)
        for batch in batches:
            label, score = np.full(batch.num_rows, len(m.labels)), np.zeros(batch.num_rows)
            for rows, data, off in C.text_groups(batch, limit=CACHED_BYTES):
                if not m.labels:
                    break
                p = predict(m, data, off)
                letters = has_letters(data, off)
                label[rows] = np.where(letters, p.argmax(1), len(m.labels))
                score[rows] = np.where(letters, p.max(1), 0.0)
            rejected = (label == len(m.labels)) | (score < m.reject_below)
            added = [pa.array(names[label], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def fit(docs: DataFrame, may_learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on a sample of the rows where ``may_learn`` holds and text and lang are not null.

    The sample has ``per_language`` documents of each language on average, chosen by a hash of doc_id, so it is bounded by the number of
    languages whatever the input; counts per language come from a scan of the two small columns.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((1, 1), np.float32), np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1 << 30, (per_language << 30) // n)).cast("long"))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < share[F.col("lang")]
    sample = rows.where(drawn & F.col("text").isNotNull()).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "lang", "text"])
    if sample.empty:
        return Model([], np.zeros((1, 1), np.float32), np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names in the input are replaced).

    A text that is null or has no letter of any script gets ``und``, score 0 and is rejected, as does every text where nothing was learned.
    A text is rejected as well where its calibrated score is below the threshold; its lang_pred stays. Texts are read whole. Equal
    texts get equal results; only the text is an input. An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(_predictor(spark.sparkContext.broadcast(model)), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, remainder("doc_id", 4) != 2)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
