"""Quality classifier: random-indexing word vectors and a two-layer numpy network.

Every whole text is read as units: runs of letters (lower-cased), of digits and of
symbols, each hashed to one of UNITS numbers, with a marker after a word written in capitals and
after a word equal to the one before. Each unit has a sparse random index vector;
its context vector is the sum of the index vectors of the units up to REACH
places away, over all texts. Tasks sum theirs, and the sums are added up by
unit, so the result has a fixed size (UNITS x DIMS). A document is the mean of its
units' index and context vectors, with its length and how concentrated its units are.

The network (one hidden layer) learns from at most SAMPLE labelled documents whose
crc32(doc_id as text) mod 5 is not 0, chosen by a hash of the doc_id. A fifth of them
is left out of learning and fits the temperature by which the output is divided, so
scores are calibrated. Labels, language, source and doc_id never enter a score.

Nulls: a null text is empty; an empty text has a zero vector and gets the score the
network gives that. Rows with a null doc_id are scored, never learned from; labels
that are null are ignored, and of several labels of a document the least counts.
Rows are scored one by one. Without any labelled row every score is 0.5. An empty
table gives an empty result. Other columns are passed through by :func:`score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, mix, small_batches, tidy

UNITS, DIMS, NONZERO, REACH = 8192, 64, 2, 2
UPPER, REPEAT = 0, 1  # the markers' units; hashed units start at 2
SAMPLE, HIDDEN, THRESHOLD = 5000, 24, 0.3
WIDTH = 2 * DIMS + 2
#: Texts are taken together up to this many characters.
BATCH_CHARS = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each character below 0x3000: its class (0 blank, 1 letter, 2 capital, 3 digit, 4 symbol), and its lower case."""
    kinds, low = np.empty(0x3000, np.uint8), np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        s = chr(c)
        kinds[c] = 0 if s.isspace() or c < 32 else 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 4
        if len(s.lower()) == 1:
            low[c] = ord(s.lower())
    return kinds, low


KINDS, LOW = _tables()


def units(text: str) -> np.ndarray:
    """The units of a whole text, with markers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.int64)
    near = np.minimum(codes, 0x2FFF)
    kind = np.where(codes < 0x3000, KINDS[near], 1).astype(np.uint8)
    low = np.where(codes < 0x3000, LOW[near], codes).astype(np.uint64)
    group = np.where(kind == 2, 1, kind)
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    x = low * np.uint64(0x9E3779B97F4A7C15)
    x[1:] += low[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    x[starts] = low[starts] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    h = np.add.reduceat(x, starts)
    lengths = np.diff(np.append(starts, len(codes)))
    capitals = np.add.reduceat((kind == 2).astype(np.int64), starts)
    shown = group[starts] != 0
    h, lengths, capitals, letters = h[shown], lengths[shown], capitals[shown], group[starts][shown] == 1
    out = np.full((len(h), 3), -1, np.int64)
    out[:, 0] = 2 + (mix(h) % np.uint64(UNITS - 2)).astype(np.int64)
    out[letters & (lengths > 1) & (capitals == lengths), 1] = UPPER
    at = np.flatnonzero(letters)
    again = at[1:][h[at[1:]] == h[at[:-1]]]
    out[again, 2] = REPEAT
    flat = out.ravel()
    return flat[flat >= 0]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each unit's nonzero entries, by a fixed rule."""
    r = np.random.default_rng(20240229)
    places = r.integers(0, DIMS, (UNITS + 1, NONZERO))
    signs = r.choice([-1, 1], (UNITS + 1, NONZERO))
    signs[UNITS] = 0  # the gap between texts
    return places, signs


def _batches(texts: list[str | None]) -> Iterator[list[str]]:
    now, size = [], 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size >= BATCH_CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def context_sums(texts: list[str], places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(UNITS, DIMS) sums of the index vectors around each unit."""
    gap = np.full(REACH, UNITS)
    s = np.concatenate([x for t in texts for x in (units(t), gap)])
    out = np.zeros(((UNITS + 1) * DIMS))
    for off in range(1, REACH + 1):
        for a, b in ((s[:-off], s[off:]), (s[off:], s[:-off])):
            for j in range(NONZERO):
                out += np.bincount(a * DIMS + places[b, j], signs[b, j], (UNITS + 1) * DIMS)
    return out.reshape(UNITS + 1, DIMS)[:UNITS]


def learn_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """(UNITS, 2 * DIMS): each unit's index vector and its context vector of unit length, from all texts."""
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros((UNITS, DIMS), np.int64)
        for batch in batches:
            for texts in _batches(batch.column(0).to_pylist()):
                total += context_sums(texts, places, signs).astype(np.int64)
        some = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array(total[some, i]) for i in range(DIMS))], names=["unit", *names])

    sums = df.select(text).mapInArrow(tidy(run), "unit int, " + ", ".join(f"{n} bigint" for n in names))
    rows = sums.groupBy("unit").agg(*(F.sum(n).alias(n) for n in names)).collect()  # UNITS rows at most
    context = np.zeros((UNITS, DIMS))
    for r in rows:
        context[r["unit"]] = r[1:]
    size = np.linalg.norm(context, axis=1, keepdims=True)
    places, signs = index_vectors()
    own = np.zeros((UNITS, DIMS))
    for j in range(NONZERO):
        own[np.arange(UNITS), places[:UNITS, j]] += signs[:UNITS, j]
    return np.hstack([own / np.sqrt(NONZERO), context / np.maximum(size, 1)]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    s = units(text or "")
    if len(s):
        counts = np.bincount(s, minlength=UNITS)
        at = np.flatnonzero(counts)
        share = (counts[at] / len(s)).astype(np.float32)
        out[: 2 * DIMS] = share @ vectors[at]
        out[2 * DIMS] = np.log1p(len(s)) / 10
        out[2 * DIMS + 1] = np.sqrt(share @ share)
    return out


class Network:
    """Scores from pooled vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 7, epochs: int = 250):
        """calibrate: the rows that fit the temperature instead of the weights."""
        self.mean, self.temperature = (x.mean(0), 1.0) if len(x) else (np.zeros(WIDTH), 1.0)
        self.scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(WIDTH)
        r = np.random.default_rng(seed)
        p = [r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        if not len(x):
            p = [q * 0 for q in p]
        self.parameters = p
        learn = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
        z, t = (x[learn] - self.mean) / self.scale, y[learn].astype(float)
        m, v = [q * 0 for q in p], [q * 0 for q in p]
        for step in range(1, epochs + 1 if len(x) else 1):
            h = np.tanh(z @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(t)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [z.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                p[i] -= 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        if calibrate.any():
            logit, t = self.logits(x[calibrate]), y[calibrate].astype(float)
            tried = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
            loss = [np.mean(np.logaddexp(0, logit / k) - t * logit / k) for k in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.parameters
        return np.tanh(((x - self.mean) / self.scale) @ p[0] + p[1]) @ p[2] + p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def learn(df: DataFrame, labels: DataFrame, vectors, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Network:
    """The network, from at most `sample` labelled documents; vectors: broadcast."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & (crc_bucket(key, 5) != 0))
    chosen = usable.groupBy(F.col(key).cast("bigint").alias("__k")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("__k"), "__k").limit(sample)
    taken = df.select(F.col(key).cast("bigint").alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), "__k")  # `sample` rows are sent

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pooled(t, vectors.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"__k": batch.column("__k"), "quality": batch.column("quality").cast(pa.int32()), "pooled": pa.array(found, pa.binary())})

    rows = taken.select("__k", "quality", "text").mapInArrow(tidy(pool), "__k bigint, quality int, pooled binary")
    rows = rows.groupBy("__k").agg(F.min("quality").alias("quality"), F.min("pooled").alias("pooled"), (F.min(crc_bucket("__k", 5)) == 1).alias("calibrate")).collect()
    rows.sort(key=lambda r: r["__k"])
    x = np.array([np.frombuffer(r["pooled"], np.float32) for r in rows], np.float64).reshape(-1, WIDTH)
    return Network(x, np.array([r["quality"] for r in rows], int), np.array([r["calibrate"] for r in rows], bool))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD, drop_text: bool = False) -> DataFrame:
    """df with score and predicted (columns of these names in df are replaced). labels: key, quality."""
    df = df.drop("score", "predicted")
    small_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    vectors = context.broadcast(learn_vectors(df, text))  # UNITS x 2 DIMS floats
    network = context.broadcast(learn(df, labels, vectors, key, text, sample))
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    place, shown = df.columns.index(text), [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([pooled(t, vectors.value) for t in batch.column(place).to_pylist()], np.float64).reshape(-1, WIDTH)
            yield pa.record_batch([*(batch.column(i) for i in shown), pa.array(network.value.scores(x), pa.float64())], names=[*(f.name for f in kept), "score"])

    out = df.mapInArrow(tidy(run), schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(documents, labels, drop_text=True)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
