"""MinHash near-dedup from bottom-k sketches with one hash function.

1. Every whole text becomes its set of word shingles (64-bit hashes). Texts with
   equal sets form a class, stood for by the row with the least doc_id. A class's
   sketch is the least values of its set; a set of up to k values is its own sketch.
2. Inverted lists of the SCREEN least values tell how many of them another class
   retains, too. A class with fewer than any similar pair shares is linked with nothing.
3. The others get sketches of K values, and inverted lists of these: each
   class is listed under its rarest values only, as many as a class similar to it cannot
   miss altogether (prefix filter), with its reach: how many of its values come
   from there on, in order of rarity. A pair overlaps at most by the lesser reach under the first value that it shares.
4. Overlaps: within each list the class that shares most stands as hub, and every other
   member within reach is paired with it. Once the links found so have been joined to
   components, a class leaves the lists where no other component holds a size that it can
   reach, and only members of different components are left to pair. As
   long as these are many, another hub is drawn first, so that large groups of copies are never
   paired with each other; none is skipped in the end.
5. Pairs are filtered by the Jaccard similarity of their union's sketch, and
   confirmed by that of the full sets.
6. Components of the confirmed links.

Between sets whose union is within SCREEN values all bounds are exact. Beyond, the number of sketch values
that a similar pair shares is bounded at SIGMAS standard deviations: a link is lost with a
probability below 1e-6, and only if its similarity is just at the limit.

Nulls: a null text is empty. A text without words has no shingles and is linked with
nothing; one with fewer words than a shingle has its whole sequence as only shingle. A null
doc_id is never the least of its class unless all are null. Repeated rows, also of one doc_id,
are rows of one class if their sets are equal. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, sheltered, tidy
from .graph import components
from .hashing import Hasher, parts

WORDS, PERCENT = 5, 80
SCREEN, K, UNION = 64, 1024, 256
SIGMAS = 6.0
#: Pairs of different components that are paired without drawing another hub first: so many for each listed value.
PAIRS_PER_ENTRY, MOST_ROUNDS = 10, 4
#: Names of texts are broadcast up to so many rows (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def shingle_sets(hasher: Hasher, texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each whole text, as signed 64-bit hashes."""
    for low, high, found in parts(texts):
        hasher.load(found)
        starts = np.arange(max(0, len(found) - words + 1))
        every = hasher.of(starts, starts + words).view(np.int64)
        first = found.first.tolist()
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                own = np.sort(every[a: b - words + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield hasher.of(np.array([a]), np.array([b])).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sketch_rows(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sizes, prints, sketches = [], [], []
                for s in shingle_sets(hasher, part.column("text"), words):
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketches.append(s[:k].copy())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "tfp": part.column("tfp"), "n": pa.array(sizes, pa.int64()), "fp": pa.array(prints, pa.binary()), "sketch": _lists(sketches)})

    return run


def _full_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                sets = list(shingle_sets(hasher, part.column("text"), words))
                yield pa.record_batch({"node": part.column("node"), "n": pa.array([len(s) for s in sets], pa.int64()), "values": _lists(sets)})

    return run


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tfp"), "text")


def _linked(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _least_overlap(n: Column, percent: int, k: int) -> Column:
    """How many of its sketch's values a set of n values shares with the sketch of any set similar to it, at least.

    A set of up to k values is its own sketch: where the union is no larger than k too, exactly the overlap is shared.
    """
    t = percent / 100
    spread = F.sqrt(F.lit(k * t * (1 - t)) * F.greatest(F.lit(0.0), 1 - k * t / n))
    overlap, drawn = F.ceil(percent * n / 100), F.floor(k * t - SIGMAS * spread)
    return F.when(n <= math.floor(k * t), overlap).when(n <= k, F.least(overlap, drawn)).otherwise(drawn).cast("int")


def _least_shared(n_a: Column, n_b: Column, percent: int, k: int) -> Column:
    """How many values the sketches of two similar sets of these sizes share, at least.

    Similar sets share ``percent / (100 + percent)`` of their sizes' sum. Up to k values a
    sketch is its set. Beyond, the sketch of the larger set reaches the least far up, and of its k values that part
    is shared which is shared of the whole set; the count is taken at its lower confidence bound.
    """
    most = F.greatest(n_a, n_b)
    part = percent * (n_a + n_b) / ((100 + percent) * most)
    drawn = k * part - SIGMAS * F.sqrt(k * part * (1 - part) * F.greatest(F.lit(0.0), 1 - k / most))
    return F.when(most <= k, F.ceil(percent * (n_a + n_b) / (100 + percent))).otherwise(F.floor(drawn))


def _pairable(a: str, b: str, percent: int, k: int) -> Column:
    """Whether sizes, and how far the two reach under a value, allow two listed classes to be similar."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return near & (F.least(F.col(f"{a}.reach"), F.col(f"{b}.reach")) >= _least_shared(n_a, n_b, percent, k))


def _in_reach(lo: Column, hi: Column, percent: int, k: int) -> Column:
    """Whether a listed class can be similar to some size from lo to hi.

    The less the smaller or, beyond k, the larger a partner is, the
    less must be shared with it; so the least and the greatest size that are near enough decide.
    """
    n = F.col("n")
    lo, hi = F.greatest(lo, F.ceil(percent * n / 100)), F.least(hi, F.floor(100 * n / percent))
    return (lo <= hi) & (F.col("reach") >= F.least(_least_shared(n, lo, percent, k), _least_shared(n, hi, percent, k)))


def _estimate(percent: int, k: int):
    """Keeps the pairs whose union's sketch is similar enough; sure: the sketches are the full sets."""
    bound = percent / 100 - SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b"))
            left, right = batch.column("sketch_a"), batch.column("sketch_b")
            out = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                common = np.intersect1d(x, y, assume_unique=True)
                if max(n_a[i], n_b[i]) <= k:
                    if _linked(len(common), n_a[i], n_b[i], percent):
                        out.append((a[i], b[i], True))
                else:
                    size = min(k, len(x) + len(y) - len(common))
                    top = np.partition(np.union1d(x, y), size - 1)[size - 1]
                    if np.count_nonzero(common <= top) >= bound * size:
                        out.append((a[i], b[i], False))
            p, q, sure = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return run


def _confirm(percent: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            left, right, out = batch.column("values_a"), batch.column("values_b"), []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    out.append((a[i], b[i]))
            p, q = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return run


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (a, b) of classes, each once."""
    pairs = keep(pairs, "pairs")
    ends = lambda of: of.select(F.col("a").alias("node")).union(of.select(F.col("b").alias("node"))).distinct()
    sketch = lambda s: own.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    own = keep(full.select("node", "n", F.slice("values", 1, UNION).alias("sketch")).join(ends(pairs), "node"), "asked-sketches")
    passed = keep(pairs.join(sketch("b"), "b").join(sketch("a"), "a").mapInArrow(tidy(_estimate(percent, UNION)), "a bigint, b bigint, sure boolean"), "estimated")
    discard(pairs, own)
    unsure = passed.where("not sure").select("a", "b")
    whole = keep(full.join(ends(unsure), "node"), "asked-sets")
    values = lambda s: whole.select(F.col("node").alias(s), F.col("values").alias(f"values_{s}"))
    confirmed = unsure.join(values("b"), "b").join(values("a"), "a").mapInArrow(tidy(_confirm(percent)), "a bigint, b bigint")
    found = keep(passed.where("sure").select("a", "b").union(confirmed), "links")
    discard(passed, whole)
    return found


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, node, rep, tfp, n, sketch) of every class: the row with the least doc_id stands for it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "tfp", "n", "sketch")).alias("first")
    return rows.where("fp is not null").groupBy("fp").agg(first).select("fp", F.col("first.row").alias("node"), F.col("first.doc_id").alias("rep"), "first.tfp", "first.n", "first.sketch")


def _screened(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The classes that share as many retained values with others as any similar pair does: (node, rep, tfp)."""
    low = classes.select("node", "n", F.explode("sketch").alias("value"))
    often = keep(low.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value"), "often")
    shared = low.join(often, "value").groupBy("node", "n").agg(F.count("*").alias("c")).where(F.col("c") >= _least_overlap(F.col("n"), percent, k))
    out = keep(classes.select("node", "rep", "tfp").join(shared.select("node"), "node"), "screened")
    discard(often)
    return out


def _full_sets(texts: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(node, n, values): the full sets of the classes that named lists."""
    count = named.count()
    named = named.select("node", F.col("rep").alias("d"), F.col("tfp").alias("t"))
    found = texts.join(F.broadcast(named) if count <= BROADCAST_ROWS else named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tfp") == F.col("t")))
    full = keep(found.select("node", "text").mapInArrow(tidy(_full_rows(words)), "node bigint, n bigint, values array<bigint>"), "sets")
    if full.count() > count:  # rows repeat a doc_id and its text
        once, again = keep(full.dropDuplicates(["node"]), "sets"), full
        discard(again)
        return once
    return full


def _inverted(full: DataFrame, percent: int, k: int) -> DataFrame:
    """The inverted lists: (value, node, n, reach, weight), each class under the values it must share with any similar one."""
    values = full.select("node", "n", F.explode(F.slice("values", 1, k)).alias("value"))
    often = keep(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = values.join(often, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    size, need = F.least(F.col("n"), F.lit(k)).cast("int"), _least_overlap(F.col("n"), percent, k)
    shared = shared.where(F.size("v") >= need).withColumn("weight", F.aggregate("v", F.lit(0).cast("bigint"), lambda x, y: x + y["df"]))
    # Values that no other class retains come first, and then the rarest; of v, as many as one more than may be missed.
    listed = shared.select("node", "n", "weight", F.size("v").alias("c"), F.posexplode(F.slice("v", F.lit(1), F.size("v") - need + 1)).alias("at", "v"))
    listed = keep(listed.select(F.col("v.value").alias("value"), "node", "n", (F.col("c") - F.col("at")).alias("reach"), "weight"), "listed")
    ends = listed.groupBy("value").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c")).where("c > 1").drop("c")
    lists = keep(listed.join(ends, "value").where(_in_reach(F.col("lo"), F.col("hi"), percent, k)).drop("lo", "hi"), "lists")
    discard(often, listed)
    return lists


def _open(lists: DataFrame, labels: DataFrame, percent: int, k: int) -> DataFrame:
    """What is left of the lists, with comp: members that can reach a size of another component there."""
    now = lists.drop("comp").join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = now.groupBy("value", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # The two least and the two greatest sizes of different components: leaving out its own, each member finds the others' ends.
    low, high = F.min(F.struct("lo", "comp")), F.max(F.struct("hi", "comp"))
    first = keep(per.groupBy("value").agg(low.alias("low"), high.alias("high"), F.count("*").alias("c")).where("c > 1").drop("c"), "first-ends")
    rest = keep(per.join(first, "value"), "ends")
    low2 = F.min(F.when(F.col("comp") != F.col("low.comp"), F.col("lo"))).alias("low2")
    high2 = F.max(F.when(F.col("comp") != F.col("high.comp"), F.col("hi"))).alias("high2")
    ends = rest.groupBy("value").agg(F.first("low").alias("low"), F.first("high").alias("high"), low2, high2)
    lo = F.when(F.col("comp") != F.col("low.comp"), F.col("low.lo")).otherwise(F.col("low2"))
    hi = F.when(F.col("comp") != F.col("high.comp"), F.col("high.hi")).otherwise(F.col("high2"))
    out = keep(now.join(ends, "value").where(_in_reach(lo, hi, percent, k)).drop("low", "high", "low2", "high2"), "open")
    discard(first, rest)
    return out


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, tfp (xxhash64 of the text), n_shingles component_id (the least doc_id linked) and first (one row of each component) of every row."""
    texts = _texts(df)
    rows = texts.mapInArrow(tidy(_sketch_rows(words, min(k, SCREEN))), "doc_id bigint, tfp bigint, n bigint, fp binary, sketch array<bigint>")
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = keep(_classes(rows), "classes")
    screened = _screened(classes, percent, min(k, SCREEN))
    full = _full_sets(texts, screened, words)
    lists = _inverted(full, percent, k).withColumn("comp", F.col("node"))
    links = labels = hubs = None
    for turn in range(MOST_ROUNDS + 1):
        last = False
        if labels is not None:
            # Twice, as those that left may have been what others could reach.
            once = _open(lists, labels, percent, k)
            lists = _open(once, labels, percent, k)
            discard(once)
            per = lists.groupBy("value", "comp").agg(F.count("*").alias("m")).groupBy("value").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("twice"), F.sum("m").alias("m"))
            left, entries = per.agg(F.sum("twice"), F.sum("m")).collect()[0]
            if not left:
                break
            last = turn == MOST_ROUNDS or left / 2 <= PAIRS_PER_ENTRY * (entries + 20_000)
        x = lists.alias("x")
        if last:
            pairs = x.join(lists.alias("y"), "value").where((F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _pairable("x", "y", percent, k)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        else:
            # A list's hub: of the components without one so far, the member that shares most.
            free = lists if hubs is None else lists.join(hubs, ["value", "comp"], "left_anti")
            drawn = free.groupBy("value").agg(F.max(F.struct("reach", "weight", F.negative("node").alias("minus"), "n", "comp")).alias("hub"))
            drawn = keep(drawn.select("value", F.negative("hub.minus").alias("node"), "hub.n", "hub.reach", "hub.comp"), "hubs")
            used = drawn.select("value", "comp")
            hubs = used if hubs is None else keep(hubs.union(used), "used")
            pairs = x.join(drawn.alias("y"), "value").where((F.col("x.comp") != F.col("y.comp")) & _pairable("x", "y", percent, k)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        found = _verify(pairs.distinct(), full, percent)
        links = found if links is None else keep(links.union(found), "links")
        labels = components(links)
        if last:
            break
    discard(full, screened)
    named = labels.join(classes.select("node", "rep"), "node")
    # Of each component the class with the least doc_id stands for it.
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least")
    least = keep(named.groupBy("component").agg(least).select("component", F.col("least.rep").alias("component_id"), F.col("least.node").alias("first")), "components")
    named = named.join(least, "component").select("node", "component_id", "first")
    named = keep(classes.select("fp", "node", "rep").join(named, "node", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", "node").alias("first")), "named")
    discard(classes)
    out = rows.select("doc_id", "tfp", "n", "fp", "row").join(named, "fp", "left")
    return out.select("doc_id", "tfp", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("first"))


def first_of_each(df: DataFrame, words: int = WORDS, percent: int = PERCENT, k: int = K) -> DataFrame:
    """The rows of df without near duplicates: of each component one row stays, as does every row without words."""
    df, restore = sheltered(df, "doc_id", "text")
    stay = near_duplicates(df, words, percent, k).where("first").select(_key("doc_id", "tfp").alias("__key"), F.col("tfp").alias("__tfp"))
    stay = keep(stay.distinct(), "stay")
    own = df.withColumn("__tfp", F.xxhash64("text"))
    own = own.withColumn("__key", _key(F.col("doc_id").cast("bigint"), "__tfp"))
    found = own.join(stay, ["__key", "__tfp"])
    # Rows that repeat doc_id and text have both found the one that stays.
    again = found.where(F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) > 0).dropDuplicates(["__key", "__tfp"])
    empty = own.where(F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0)
    return restore(again.select(*df.columns).union(empty.select(*df.columns)))


def _key(doc_id, tfp) -> Column:
    return F.xxhash64(doc_id, tfp, F.lit("row"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(documents, words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Shingles of all documents and their overlaps, and what the links reach: for inputs whose pairs a single machine can hold.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
s AS MATERIALIZED (
  SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [hash(array_to_string(words, ' '), len(words))]
    ELSE list_transform(range(1, len(words) - 1), lambda i: hash(array_to_string(words[i:i + 2], ' '), 3)) END) AS shingles FROM w
),
classes AS MATERIALIZED (SELECT min(r) AS c, list_sort(shingles) AS shingles, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles), len(shingles)),
each AS (SELECT c, n, unnest(shingles) AS h FROM classes),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM each a JOIN each b ON a.h = b.h AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached(c, t) AS (SELECT c, c FROM classes UNION SELECT reached.c, links.b FROM reached JOIN links ON links.a = reached.t),
members AS (SELECT s.doc_id, classes.c FROM s JOIN classes ON list_sort(s.shingles) = classes.shingles),
least AS (SELECT reached.c, min(members.doc_id) AS component_id FROM reached JOIN members ON members.c = reached.t GROUP BY reached.c),
found AS (SELECT s.doc_id, len(s.shingles) AS n, least.component_id FROM s LEFT JOIN classes ON list_sort(s.shingles) = classes.shingles LEFT JOIN least ON least.c = classes.c)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM found
"""
