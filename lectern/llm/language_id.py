"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the weighted sum, over n-gram lengths, of the number of
hashed character n-grams that both contain, divided by the root of the
product of how many each contains. Landmarks from the learning rows give a Nyström map, and
one-versus-rest kernel ridge regression on a bounded sample of those rows gives a
weight per landmark and language. As the kernel is linear in n-gram presence, the
landmarks' weights fold into one matrix (n-gram by language) for each length, and a
batch of texts is scored by matrix products of presence and that matrix.

Learning reads text and language only, of rows with a language and a letter whose crc32(doc_id as
text) mod 3 is not 1; at most SAMPLE of them, chosen by a hash of the doc_id, so
the driver holds SAMPLE bit vectors at most. Scoring reads the whole text alone.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows with a
null doc_id are scored and never learned from. Repeated rows are scored one by
one; an empty table gives an empty result. With a single language in the learning
rows that language is always predicted; with none, ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches

#: n-gram lengths with their weight in the kernel, and bits of presence for each.
SPECTRUM, BITS = ((1, 0.5), (2, 1.0), (3, 1.5)), 1 << 14
#: Bounds of learning: rows, and landmarks among them.
SAMPLE, LANDMARKS = 4000, 256
#: Ridge strength, by cross-checking on learning rows.
RIDGE = 1e-3
_LETTER = re.compile(r"[^\W\d_]")


def presence(text: str) -> list[np.ndarray]:
    """For each length, the sorted buckets of the whole text's n-grams. A text reads as if between blanks."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n, _ in SPECTRUM:
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]) if n > 1 else codes
        seen = np.zeros(BITS, bool)
        seen[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)] = True
        out.append(np.flatnonzero(seen))
    return out


def readable(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _bits(text: str) -> bytes:
    out = []
    for at in presence(text):
        seen = np.zeros(BITS, bool)
        seen[at] = True
        out.append(np.packbits(seen).tobytes())
    return b"".join(out)


class Model:
    """Languages in order, and for each n-gram length a matrix (bucket, language)."""

    def __init__(self, languages: list[str], folded: list[np.ndarray], bias: np.ndarray):
        self.languages, self.folded, self.bias = languages, folded, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.bias, (len(texts), 1))
        for n, found in enumerate(zip(*(presence(t) for t in texts), strict=True)):
            sizes = np.array([len(x) for x in found])
            rows = self.folded[n][np.concatenate(found)]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out += np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes)[:, None]
        return out


def fit(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: presence of each learning row, as packed by the executors."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], [], np.zeros(0))
    width, order = BITS // 8, np.array(langs)

    def rows(at) -> list[np.ndarray]:
        """Presence of some rows, scaled so that products are kernel values."""
        out = []
        for n, (_, w) in enumerate(SPECTRUM):
            m = np.unpackbits(np.frombuffer(b"".join(bits[i][n * width : (n + 1) * width] for i in at), np.uint8).reshape(len(at), width), axis=1).astype(np.float32)
            out.append(m * (np.sqrt(w) / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))))
        return out

    # Landmarks: the same number of each language as far as there are, in the sample's order.
    marks = np.concatenate([np.flatnonzero(order == g)[: max(1, landmarks // len(languages))] for g in languages])
    own = rows(marks)
    cross = np.concatenate([sum(m @ o.T for m, o in zip(rows(range(low, min(low + 256, len(bits)))), own, strict=True)) for low in range(0, len(bits), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(cross[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: kernel rows to features
    features = cross @ root
    target = np.where(order[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language's rows count alike.
    share = np.array([(order == g).mean() for g in langs])
    weight = 1 / (share * len(languages))
    bias = (target * weight[:, None]).sum(0) / weight.sum()
    gram = (features * weight[:, None]).T @ features
    solved = np.linalg.solve(gram + ridge * len(bits) * np.eye(gram.shape[0]), (features * weight[:, None]).T @ (target - bias))
    dual = root @ solved
    folded = [(o.T @ dual) * np.sqrt(w) for o, (_, w) in zip(own, SPECTRUM, strict=True)]
    return Model(languages, folded, bias)


def learn(df: DataFrame, sample: int = SAMPLE) -> Model:
    """df: doc_id, text, lang; only the rows that may be learned from."""
    rows = df.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A sorted top of fixed size: each task keeps at most `sample` ids.
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    last = chosen.agg(F.max_by("doc_id", F.struct(F.xxhash64("doc_id"), F.col("doc_id"))).alias("d")).collect()[0]["d"]
    if last is None:
        return fit([], [])
    edge = F.struct(F.xxhash64(F.lit(last).cast("bigint")), F.lit(last).cast("bigint"))
    taken = rows.where(F.struct(F.xxhash64("doc_id"), F.col("doc_id")) <= edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, g, _bits(t)) for d, g, t in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "lang", "text")), strict=True) if readable(t)]
            d, g, b = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({"doc_id": pa.array(d, pa.int64()), "lang": pa.array(g, pa.string()), "bits": pa.array(b, pa.binary())})

    got = taken.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id bigint, lang string, bits binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("row")).collect()  # one row of each id
    got.sort(key=lambda r: r["doc_id"])
    return fit([bytes(r["row"]["bits"]) for r in got], [r["row"]["lang"] for r in got])


def predict(df: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry (bigint or string columns; those named lang_pred or score are replaced), lang_pred and score."""
    small_batches(df.sparkSession)
    carry = tuple(c for c in carry if c not in ("lang_pred", "score"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*carry, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column("__text").to_pylist()
                told = [i for i, t in enumerate(texts) if readable(t)] if m.languages else []
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if told:
                    raw = m.scores([texts[i] for i in told])
                    for i, best, odds in zip(told, raw.argmax(1), 1 / (1 + np.exp(-4 * raw.max(1))), strict=True):
                        langs[i], scores[i] = m.languages[best], float(odds)
                yield pa.record_batch([*(part.column(c) for c in carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents.select("doc_id", "text", "lang").where(crc_bucket("doc_id", 3) != 1))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
