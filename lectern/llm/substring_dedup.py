"""Substring dedup by relative Lempel-Ziv parsing of documents against a corpus-wide reference.

The reference is the corpus, cut into phrases: maximal stretches of windows (35
words by default) that share a minimizer, the least hash of the 8-word seeds in a window.
Where a text repeats, its phrases repeat, because a window's minimizer depends on
nothing outside it. A reference block holds the phrases under one minimizer, each with the first and
the last place where it occurs; so a document's phrase is compared with every block that
can match it, and no other is visited.

Each document is parsed greedily from left to right. A factor (start, length, source) is a stretch that
occurs again, word for word, from its source on; it is extended by the next phrase for as long as one of its sources
goes on with that phrase too, and ends where none does. At a factor's boundary, where a block
holds phrases that begin or end elsewhere, windows are checked one by one
against all windows of that block, and extend or start factors likewise. Every factor is at least a window long, and a
word is covered by factors if and only if some window over it starts elsewhere too, in
the same document or another. Phrases and windows are compared by hashes of 128 bits.

Counts and ends are summed by key before and after each shuffle; no group is ever
gathered in one task but the pieces of one document, and all tables that a hot key could skew are written first, so
that adaptive execution splits its partitions.

Nulls: a null text has no words. Rows are told apart by doc_id and text, so rows that
repeat both count as two documents and get the same result. A null doc_id is an
id like any other. An empty table gives an empty result. Texts are read whole, and a text
of one word repeated is cut into one phrase per window. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, tidy
from .hashing import Hasher, Words, parts

WINDOW, SEED = 35, 8
#: A phrase or a window: equal exactly where these are.
_KEY = ["h0", "h1"]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of this width, the place of its least value, the leftmost of equal ones."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, at = np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])
        have += step
    return at


def phrases(hasher: Hasher, words: Words, window: int = WINDOW, seed: int = SEED):
    """(text, minimizer, first window, number of windows) of the phrases of some texts, whose words the hasher holds."""
    n = len(words) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    starts = np.arange(len(words) - seed + 1)
    seeds = hasher.of(starts, starts + seed)
    at = least_places(seeds, window - seed + 1)
    whole = text[:n] == text[window - 1:]
    same = whole[1:] & whole[:-1] & (at[1:] == at[:-1]) & (text[1:n] == text[: n - 1])
    first = np.flatnonzero(whole & ~np.concatenate([[False], same]))
    last = np.flatnonzero(whole & ~np.concatenate([same, [False]]))
    return text[first], seeds[at[first]], first, last - first + 1


def _hashers() -> tuple[Hasher, Hasher]:
    return Hasher(0), Hasher(1)


def _phrase_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _hashers()
        for batch in batches:
            for low, _, words in parts(batch.column("text")):
                for lane in lanes:
                    lane.load(words)
                text, block, first, count = phrases(lanes[0], words, window, seed)
                h0, h1 = (lane.of(first, first + count + window - 1).view(np.int64) for lane in lanes)
                of = pa.array(low + text)
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(of), "fp": batch.column("fp").take(of), "block": block.view(np.int64), "h0": h0, "h1": h1, "start": pa.array(first - words.first[text], pa.int32()), "n": pa.array(count, pa.int32())})

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _hashers()
        for batch in batches:
            for low, high, words in parts(batch.column("text")):
                for lane in lanes:
                    lane.load(words)
                spans = batch.column("spans").slice(low, high - low)
                start, n, copies = (spans.flatten().field(k).to_numpy() for k in ("start", "n", "copies"))
                text = np.repeat(np.arange(high - low), spans.value_lengths().to_numpy())
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at, of = np.repeat(start, n) + within, np.repeat(text, n)
                place = at + words.first[of]
                h0, h1 = (lane.of(place, place + window).view(np.int64) for lane in lanes)
                row = pa.array(low + of)
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(row), "fp": batch.column("fp").take(row), "h0": h0, "h1": h1, "start": pa.array(at, pa.int32()), "copies": pa.array(np.repeat(copies, n), pa.int64())})

    return run


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")


def _ends(place) -> list:
    return [F.min(place).alias("first"), F.max(place).alias("last")]


def pieces(df: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, start, n, first, last): the n windows from start on occur elsewhere too; first and last: places of theirs. fp: xxhash64 of the text."""
    rows = keep(_texts(df).mapInArrow(tidy(_phrase_rows(window, seed)), "doc_id bigint, fp bigint, block bigint, h0 bigint, h1 bigint, start int, n int"), "phrases")
    blocks = rows.groupBy("block").agg(F.count("*").alias("c"), *(f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in _KEY))
    mixed = (F.col("min_h0") != F.col("max_h0")) | (F.col("min_h1") != F.col("max_h1"))
    blocks = keep(blocks.where("c > 1").select("block", mixed.alias("mixed")), "blocks")
    shared = keep(rows.join(blocks, "block"), "shared")
    discard(rows, blocks)
    place = F.struct("doc_id", "fp", "start")
    entries = keep(shared.groupBy("block", *_KEY, "mixed").agg(F.count("*").alias("copies"), F.max("n").alias("n"), *_ends(place)), "entries")
    recurring = entries.where("copies > 1").select("block", *_KEY, "first", "last")
    whole = keep(shared.join(recurring, ["block", *_KEY]).select("doc_id", "fp", "start", "n", "first", "last"), "recurring")
    discard(shared)
    # Blocks with several phrases: one place of each stands for its copies, and its windows meet those of the others.
    per_text = entries.where("mixed").select(F.col("first.doc_id").alias("d"), F.col("first.fp").alias("f"), F.struct("first.start", "n", "copies").alias("span"))
    per_text = keep(per_text.groupBy("d", "f").agg(F.collect_list("span").alias("spans")), "spans")
    discard(entries)
    # Rows that repeat a doc_id and its text need no care here: all their phrases have copies.
    texts = _texts(df).join(per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))).select("doc_id", "fp", "text", "spans")
    windows = keep(texts.mapInArrow(tidy(_window_rows(window)), "doc_id bigint, fp bigint, h0 bigint, h1 bigint, start int, copies bigint"), "windows")
    twice = windows.groupBy(*_KEY).agg(F.sum("copies").alias("c"), F.min("copies").alias("least"), *_ends(place))
    twice = keep(twice.where("c > 1 and least = 1").select(*_KEY, "first", "last"), "twice")
    edges = keep(windows.where("copies = 1").join(twice, _KEY).select("doc_id", "fp", "start", F.lit(1).alias("n"), "first", "last"), "edges")
    discard(per_text, windows, twice)
    return whole.union(edges)


_PLACE = pa.struct([("doc_id", pa.int64()), ("fp", pa.int64()), ("start", pa.int32())])
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", _PLACE)])
#: Pieces that are parsed together, in whole texts.
_TOGETHER = 1 << 14


class _Places:
    """Places (doc_id, fp, start), doc_id with nulls as a column of its own."""

    def __init__(self, none: np.ndarray, doc_id: np.ndarray, fp: np.ndarray, start: np.ndarray):
        self.columns = none, doc_id, fp, start

    @classmethod
    def of(cls, structs: pa.StructArray, order: np.ndarray) -> _Places:
        doc_id, fp, start = structs.flatten()
        return cls(*(x.to_numpy(zero_copy_only=False)[order] for x in (doc_id.is_null(), doc_id.fill_null(0), fp, start)))

    def __getitem__(self, at) -> _Places:
        return _Places(*(x[at] for x in self.columns))

    def where(self, mask: np.ndarray, other: _Places) -> _Places:
        return _Places(*(np.where(mask, x, y) for x, y in zip(self.columns, other.columns, strict=True)))

    def moved(self, other: _Places, by) -> np.ndarray:
        """Whether the other places are these, so many words on."""
        none, doc_id, fp, start = (x == y for x, y in zip((*self.columns[:3], self.columns[3] + by), other.columns, strict=True))
        return none & doc_id & fp & start

    def array(self) -> pa.StructArray:
        none, doc_id, fp, start = self.columns
        return pa.StructArray.from_arrays([pa.array(doc_id, pa.int64(), mask=none), pa.array(fp, pa.int64()), pa.array(start, pa.int32())], fields=list(_PLACE))


def parse(doc_id: pa.Array, fp: pa.Array, pieces: pa.ListArray, window: int = WINDOW) -> pa.ListArray:
    """The factors (start, length, source) of each text (doc_id, fp) from its pieces (start, n, first, last).

    A source is a place (doc_id, fp, start) from which on the factor's words stand again.
    """
    text = np.repeat(np.arange(len(pieces)), pieces.value_lengths().to_numpy())
    at, n, first, last = pieces.flatten().flatten()
    order = np.lexsort((at.to_numpy(), text))
    at, n = at.to_numpy()[order].astype(np.int64), n.to_numpy()[order].astype(np.int64)
    first, last = _Places.of(first, order), _Places.of(last, order)
    own = _Places(*(x.to_numpy(zero_copy_only=False)[text] for x in (doc_id.is_null(), doc_id.fill_null(0), fp)), at)
    # Rows that repeat doc_id and text are each other's source, at the same place.
    first = last.where(first.moved(own, 0) & ~last.moved(own, 0), first)
    last = first.where(last.moved(own, 0), last)
    # Piece i's sources are the nodes i (first) and i + size (last). Where the next piece goes on from a node, that is followed to the last such.
    size = len(at)
    to = np.arange(2 * size)
    joined = (text[1:] == text[:-1]) & (at[1:] == at[:-1] + n[:-1])
    step = at[1:] - at[:-1]
    for low, here in ((0, first), (size, last)):
        for beyond, there in ((size, last), (0, first)):
            on = np.flatnonzero(joined & here[:-1].moved(there[1:], step))
            to[low + on] = beyond + on + 1
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    reach = to % max(size, 1)
    ends = np.maximum(reach[:size], reach[size:])
    heads, i, leap = [], 0, ends.tolist()
    while i < size:
        heads.append(i)
        i = leap[i] + 1
    heads = np.array(heads, np.int64)
    tails = ends[heads]
    source = first[heads].where(reach[heads] == tails, last[heads]).array()
    length = at[tails] + n[tails] - at[heads] + window - 1
    factors = pa.StructArray.from_arrays([pa.array(at[heads], pa.int32()), pa.array(length, pa.int32()), source], fields=list(_FACTOR))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[heads], np.arange(len(pieces) + 1)), pa.int32()), factors)


def _factor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, low = np.cumsum(batch.column("pieces").value_lengths().to_numpy().astype(np.int64)), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _TOGETHER, "right")))
                doc_id, fp, own = batch.slice(low, high - low).columns
                yield pa.record_batch({"doc_id": doc_id, "fp": fp, "factors": parse(doc_id, fp, own, window)})
                low = high

    return run


def factorize(df: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, factors) of every text with repeats; factors: its start, length and source in the order of the text."""
    found = pieces(df, window, seed).groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "n", "first", "last")).alias("pieces"))
    return found.mapInArrow(tidy(_factor_rows(window)), "doc_id bigint, fp bigint, factors array<struct<start:int,length:int,source:struct<doc_id:bigint,fp:bigint,start:int>>>")


def remove_repeats(df: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors and kept (the words left, joined by blanks) of every row."""
    spans = F.transform("factors", lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length"))).alias("spans")
    found = keep(factorize(df, window, seed).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), spans), "repeats")
    texts = _texts(df).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                total, gone, factors, kept = [], [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    if not own.is_valid:
                        gone.append(0)
                        factors.append(0)
                        kept.append(b" ".join(words))
                        continue
                    starts, lengths = (own.values.field(k).to_numpy() for k in ("start", "length"))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + lengths, -1)
                    left = np.cumsum(step[:-1]) == 0
                    kept.append(b" ".join([w for w, k in zip(words, left.tolist(), strict=True) if k]))
                    gone.append(len(words) - int(left.sum()))
                    factors.append(len(starts))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_factors": pa.array(factors, pa.int64()), "kept": pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())})

    return texts.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, n_removed bigint, n_factors bigint, kept string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS s FROM w WHERE len(words) >= {WINDOW}),
windows AS (SELECT r, s, sha256(array_to_string(words[s:s + {WINDOW - 1}], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
found AS (SELECT r, s FROM windows JOIN twice USING (h)),
gone AS (SELECT DISTINCT r, s + unnest(range(0, {WINDOW})) AS i FROM found),
each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
