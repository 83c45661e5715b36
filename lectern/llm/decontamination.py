"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased stretches between blanks without punctuation at their ends. Every
n-gram of a test item is counted in all documents; an item's seeds are all but so many of its commonest
n-grams (SEEDS_LEAST at least stay) that a copy which reaches the threshold by replaced or deleted words always holds one;
words put in between so many of its words that hardly any neighbours are left can still hide a copy. A document where a seed occurs has
its passage around that place, as long as the item and half as much to either side, aligned with the
item by words: a match scores 2, a mismatch or a gap -1. The score is the best
local alignment's, divided by that of the item with itself. A passage that shares too few of
the item's words to reach the threshold is not aligned, since its score cannot reach it.
A document is contaminated if an item scores THRESHOLD or more. Items of fewer than MIN_WORDS words, of
which ordinary prose holds parts by chance, are not aligned: a document that holds all their words in a row scores 1.

Items are taken in blocks of BLOCK_ITEMS, which bounds what is broadcast; each block is
held against all documents.

Nulls: a null text is empty and clean. Items that are null or have no
words are left out. Of items that score alike, the one
with the smallest item_id is reported. Rows are judged one by one, so repeated rows get the same result. An
empty documents table gives an empty result, an empty benchmark clean documents. Other columns are passed
through; columns named like those added here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, tidy
from .hashing import Hasher, Words, parts

N, MIN_WORDS, SEEDS_LEAST, THRESHOLD = 2, 8, 8, 0.4
BLOCK_ITEMS = 20_000
EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡«»¿“”„‘’…–—"
ADDED = ("contaminated", "item_id", "item_score")


_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in EDGES if ord(c) < 128]] = True
#: Control characters that end a word as blanks do, though the columns' hashes do not take them for blanks.
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = True


class Vocabulary:
    """The words of some items, numbered from 1; 0 for any other word."""

    def __init__(self, known: dict[str, int]):
        outer = self.known = known

        class Cache(dict):
            def __missing__(self, chunk: str) -> int:
                word = chunk.strip(EDGES)
                out = self[chunk] = outer.get(word, 0) if word else -1
                return out

        class Foreign(dict):
            def __missing__(self, chunk: bytes) -> int:
                word = chunk.decode("utf-8", "surrogatepass").lower()
                short = word.strip(EDGES)
                out = self[chunk] = -2 if word.split() != [word] else outer.get(short, 0) if short else -1
                return out

        self.cache, self.foreign, self.hasher = Cache(), Foreign(), Hasher(lower=True)
        own = Words(np.frombuffer(" ".join(known).encode("utf-8", "surrogatepass"), np.uint8), np.zeros(1, np.int64))
        self.hasher.load(own)
        order = np.argsort(self.hasher.words)
        self.hashes, self.numbers = self.hasher.words[order], np.fromiter(known.values(), np.int64, len(known))[order]
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, text: str | None) -> np.ndarray:
        if len(self.cache) > 300_000:
            self.cache.clear()
        chunks = (text or "").lower().split()
        out = np.fromiter(map(self.cache.__getitem__, chunks), np.int64, len(chunks))
        return out[out >= 0]

    def every(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """What ids() gives for each text of a column; words of ASCII and Latin-1 letters are looked up by their hashes, all at once."""
        for low, high, words in parts(texts):
            raw, starts, ends = words.data, words.starts, words.ends
            data = words.data = raw.copy()
            # Letters of Latin-1, 0xC3 and another byte, are lowered in place like ASCII; words with other letters are looked up one by one.
            latin = np.flatnonzero(raw == 0xC3) + 1
            foreign = raw >= 128
            foreign[latin - 1] = foreign[latin] = False
            upper = latin[(raw[latin] < 0x9F) & (raw[latin] != 0x97)]
            data[upper] += 0x20
            high_bytes = np.concatenate([[0], np.cumsum(foreign)])
            foreign = np.flatnonzero(high_bytes[ends] > high_bytes[starts])
            chunks = [raw[a:b].tobytes() for a, b in zip(starts[foreign].tolist(), ends[foreign].tolist(), strict=True)]
            at = np.arange(len(starts))
            while len(at := at[(starts[at] < ends[at]) & _EDGE[data[np.minimum(starts[at], len(data) - 1)]]]):
                starts[at] += 1
            at = np.arange(len(starts))
            while len(at := at[(starts[at] < ends[at]) & _EDGE[data[ends[at] - 1]]]):
                ends[at] -= 1
            self.hasher.load(words)
            hashes, ids = self.hasher.words, np.zeros(len(starts), np.int64)
            some = np.flatnonzero(self.quick[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            if len(some) and len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
                ids[some] = np.where(self.hashes[place] == hashes[some], self.numbers[place], 0)
            ids[starts == ends] = -1
            if len(self.foreign) > 300_000:
                self.foreign.clear()
            split = np.zeros(high - low, bool)  # texts with blanks beyond ASCII are read one by one
            ids[foreign] = np.fromiter(map(self.foreign.__getitem__, chunks), np.int64, len(chunks))
            split[np.searchsorted(words.first, foreign[ids[foreign] == -2], "right") - 1] = True
            odd = np.flatnonzero(_ODD[data])
            split[np.searchsorted(words.bounds, odd, "right") - 1] = True
            first = words.first.tolist()
            for i in range(high - low):
                if split[i]:
                    yield self.ids(texts[low + i].as_py())
                else:
                    own = ids[first[i]: first[i + 1]]
                    yield own[own >= 0]


def split_words(text: str | None) -> list[str]:
    return [w for w in (c.strip(EDGES) for c in (text or "").lower().split()) if w]


def grams(ids: np.ndarray, base: int, n: int) -> np.ndarray:
    """A number for each n-gram; -1 where a word is unknown."""
    if len(ids) < n:
        return np.empty(0, np.int64)
    out, known = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        out, known = out * base + part, known & (part > 0)
    out[~known] = -1
    return out


def hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of so many words."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = mix(out + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1))
    return out


def _ranges(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[w] to first[w + 1] - 1 for each w in a row, and how many they are for each."""
    each = first[which + 1] - first[which]
    return np.arange(each.sum()) + np.repeat(first[which] - np.cumsum(each) + each, each), each


class Items:
    """The items of one block, and where each n-gram stands in them."""

    def __init__(self, rows: list[tuple[int, str]], n: int = N, min_words: int = MIN_WORDS):
        self.n, self.known, self.item_ids, self.words = n, {}, [], []
        for item, text in sorted(rows, key=lambda r: r[0]):
            words = split_words(text)
            if words:
                self.item_ids.append(item)
                self.words.append(np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64))
        self.base = len(self.known) + 1
        self.short: dict[int, dict[int, list[int]]] = {}  # number of words -> their hash -> items
        for i, w in enumerate(self.words):
            if len(w) < max(n, min_words):
                self.short.setdefault(len(w), {}).setdefault(int(hashes(w, len(w))[0]), []).append(i)
        self.short_hashes = {size: np.array(sorted(own), np.uint64) for size, own in self.short.items()}
        self.aligned = np.array([len(w) >= max(n, min_words) for w in self.words], bool)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.different = [np.unique(w, return_counts=True) for w in self.words]
        # Under each word the items that hold it, and how often.
        pairs, self.uses = np.unique(np.concatenate(self.words) * len(self.words) + np.repeat(np.arange(len(self.words)), self.sizes) if self.words else np.empty(0, np.int64), return_counts=True)
        word, self.use_items = np.divmod(pairs, max(1, len(self.words)))
        self.first_use = np.searchsorted(word, np.arange(self.base + 1))
        per_item = self.grams()
        self.codes = np.unique(np.concatenate(per_item)) if per_item else np.empty(0, np.int64)
        self.choose(None, per_item)

    def grams(self) -> list[np.ndarray]:
        """The n-grams of each item; none of those that are not aligned."""
        return [grams(w, self.base, self.n) if a else np.empty(0, np.int64) for w, a in zip(self.words, self.aligned, strict=True)]

    def verbatim(self, ids: np.ndarray) -> int | None:
        """The first of the items that are not aligned whose words stand in a row."""
        found = None
        for size, known in self.short_hashes.items():
            own = hashes(ids, size)
            for at in np.flatnonzero(np.isin(own, known)).tolist():
                for i in self.short[size][int(own[at])]:
                    if (found is None or i < found) and np.array_equal(self.words[i], ids[at : at + size]):
                        found = i
        return found

    def choose(self, counts: np.ndarray | None, per_item: list[np.ndarray] | None = None, least: int = SEEDS_LEAST, threshold: float = THRESHOLD) -> None:
        """Keep as seeds all but the commonest n-grams of each item that a copy can lack; all of them while there are no counts.

        A copy with m words left and e replaced or deleted scores (2 m - e) / 2 n, and e errors leave at least m - e - 1 pairs of
        neighbours. At the threshold that is (4 threshold - 1) n / 3 - 1 or more, so that with fewer of them left out a seed remains.
        """
        seeds, items, places = [], [], []
        for i, own in enumerate(per_item or self.grams()):
            at = np.searchsorted(self.codes, own)
            chosen = np.ones(len(own), bool)
            if counts is not None:
                different, times = np.unique(at, return_counts=True)
                rank = np.argsort(counts[different], kind="stable")
                order, spare = different[rank], np.ceil((4 * threshold - 1) * self.sizes[i] / 3 - 1 - 1e-9) - 1 if self.n == 2 else 0
                left_out = np.count_nonzero(np.cumsum(times[rank][::-1]) <= spare)
                chosen = np.isin(at, order[: max(least, len(order) - left_out)])
            seeds.append(own[chosen])
            items.append(np.full(chosen.sum(), i))
            places.append(np.flatnonzero(chosen))
        flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        s, i, p = flat(seeds), flat(items), flat(places)
        order = np.argsort(s, kind="stable")
        s, self.seed_items, self.seed_places = s[order], i[order].astype(np.int64), p[order]
        self.seeds, self.first = np.unique(s, return_index=True)
        self.first = np.append(self.first, len(s))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.seeds & 0xFFFFF] = True

    def held(self, ids: np.ndarray) -> np.ndarray:
        """How many of each item's words, repeats counted, a text holds at all."""
        words, n = np.unique(ids[ids > 0], return_counts=True)
        k, each = _ranges(self.first_use, words)
        return np.bincount(self.use_items[k], np.minimum(self.uses[k], np.repeat(n, each)), len(self.words))

    def spread(self, at: np.ndarray, which: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items wanted, position in the text and place in the item of all seeds found."""
        k, each = _ranges(self.first, which)
        good = wanted[self.seed_items[k]]
        return self.seed_items[k][good], np.repeat(at, each)[good], self.seed_places[k][good]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a seed stands, and which."""
        at = np.flatnonzero(self.quick[codes & 0xFFFFF] & (codes >= 0))
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.seeds, codes[at]), len(self.seeds) - 1)
        good = self.seeds[which] == codes[at]
        return at[good], which[good]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each item with its passage, as a share of the item's own score."""
    if not items:
        return np.empty(0)
    rows, width, height = len(items), max(map(len, passages)), max(map(len, items))
    p, q = np.full((rows, width), -1, np.int64), np.full((rows, height), -2, np.int64)
    for k, (a, b) in enumerate(zip(items, passages, strict=True)):
        q[k, : len(a)], p[k, : len(b)] = a, b
    steps = np.arange(width + 1, dtype=np.int32)
    above, best = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32)
    for i in range(height):
        now = np.zeros_like(above)
        now[:, 1:] = np.maximum(above[:, :-1] + np.where((p == q[:, i : i + 1]) & (p > 0), 2, -1), above[:, 1:] - 1)
        np.maximum(now, 0, out=now)
        above = np.maximum.accumulate(now + steps, axis=1) - steps  # gaps along the passage
        best = np.maximum(best, above.max(1))
    return best / np.array([2 * len(a) for a in items])


def judge(texts: pa.Array | list[str | None], items: Items, vocabulary: Vocabulary, threshold: float = THRESHOLD) -> list[tuple[int | None, float]]:
    """For each text the best item (by number) that reaches the threshold, and its score."""
    out: list[tuple[int | None, float]] = [(None, 0.0)] * len(texts)
    todo: list[tuple[int, int, np.ndarray]] = []

    def work() -> None:
        scores = align([items.words[i] for _, i, _ in todo], [p for *_, p in todo])
        for (t, i, _), s in zip(todo, scores.tolist(), strict=True):
            if s >= threshold and (s > out[t][1] or s == out[t][1] and i < out[t][0]):
                out[t] = (i, s)
        todo.clear()

    mark = np.zeros(items.base, np.int64)
    for t, ids in enumerate(vocabulary.every(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))):
        if items.short and (i := items.verbatim(ids)) is not None and (out[t][1] < 1 or i < out[t][0]):
            out[t] = (i, 1.0)
        at, which = items.find(grams(ids, items.base, items.n))
        if len(at):
            i, place, q = items.spread(at, which, items.held(ids) >= threshold * items.sizes)
            slack = np.maximum(4, items.sizes[i] // 2)
            start = (place - q) // slack * slack  # passages that start in the same stretch are one
            zero = 2 * int(items.sizes.max())
            i, start = np.divmod(np.unique(i * (zero + len(ids)) + start + zero), zero + len(ids))
            start -= zero
            ends = [0, *(np.flatnonzero(np.diff(i, append=-1)) + 1).tolist()]
            for low, high in zip(ends, ends[1:], strict=False):
                item = int(i[low])
                size, slack = len(items.words[item]), max(4, len(items.words[item]) // 2)
                a, b = np.maximum(0, start[low:high] - slack), np.clip(start[low:high] + size + 2 * slack, 0, len(ids))
                words, most = items.different[item]
                mark[words] = np.arange(1, len(words) + 1)
                own = mark[ids]
                mark[words] = 0
                held = np.flatnonzero(own)
                first, last = np.searchsorted(held, a), np.searchsorted(held, b)
                good = last - first >= threshold * size
                if not good.any():
                    continue
                a, b, first, last = a[good], b[good], first[good], last[good]
                before = np.zeros((len(held) + 1, len(words)), np.int32)
                before[np.arange(1, len(held) + 1), own[held] - 1] = 1
                before = np.cumsum(before, axis=0, dtype=np.int32)
                both = np.minimum(before[last] - before[first], most).sum(1)
                todo += [(t, item, ids[a[k] : b[k]]) for k in np.flatnonzero(both >= threshold * size).tolist()]
        if len(todo) >= 512:
            work()
    work()
    return out


def _counts(df: DataFrame, text: str, items: Items) -> np.ndarray:
    """How often each of the items' n-grams occurs in all documents."""
    sent = df.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        vocabulary, total = Vocabulary(own.known), np.zeros(len(own.seeds), np.int64)
        for batch in batches:
            for ids in vocabulary.every(batch.column(0)):
                _, which = own.find(grams(ids, own.base, own.n))
                np.add.at(total, which, 1)
        some = np.flatnonzero(total)
        yield pa.record_batch({"seed": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(len(items.codes), np.int64)
    for r in df.select(text).mapInArrow(tidy(run), "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        out[r["seed"]] = r["n"]  # at most as many rows as the block has n-grams
    return out


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """df with contaminated, item_id (null if clean) and item_score. benchmark: item_id, text."""
    df = df.drop(*ADDED)
    small_batches(df.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").selectExpr("cast(item_id as bigint) item_id", "text")
    n_blocks = max(1, -(-items.count() // block_items))
    out = df.withColumns({"item_id": F.lit(None).cast("bigint"), "item_score": F.lit(0.0)})
    for block in range(n_blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()]
        own = Items(rows)
        if len(own.item_ids):
            own.choose(_counts(df, text, own), threshold=threshold)
            out = _with_block(out, own, text, threshold)
    return out.withColumn("contaminated", F.col("item_id").isNotNull())


def _with_block(df: DataFrame, items: Items, text: str, threshold: float) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(items)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        vocabulary = Vocabulary(own.known)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                columns = {n: part.column(k) for k, n in enumerate(names)}
                before = zip(columns["item_id"].to_pylist(), columns["item_score"].to_pylist(), strict=True)
                found = judge(columns[text], own, vocabulary, threshold)
                best = [(own.item_ids[i], s) if i is not None and (s, -own.item_ids[i]) > (b[1], -(b[0] or 0)) else b for (i, s), b in zip(found, before, strict=True)]
                columns["item_id"] = pa.array([b[0] for b in best], pa.int64())
                columns["item_score"] = pa.array([b[1] for b in best], pa.float64())
                yield pa.record_batch(list(columns.values()), names=names)

    return df.mapInArrow(tidy(run), df.schema)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(documents, benchmark).select("doc_id", "contaminated", "item_id", "item_score")
