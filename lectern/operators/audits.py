"""Corpus-wide reports: coverage, marker anomalies, identity, inventory and censuses. Each is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import invalid_literal, is_clean_cts, literal_shape, positive_int
from ..functions.vocabulary import LAYOUT, VERSE
from ..plans.parse import REC, Corpus
from .aggregates import by_each, histogram, smallest
from .relations import analysis_digests, unresolved_witnesses, witness_targets
from .windows import missing_numbers, topology


def coverage(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """Runs and words by status, for each corpus, book and reason on its own and over all."""
    r = resolved.join(documents.select(REC, "corpus"), REC).withColumn("n", F.col("last") - F.col("first") + 1)
    return by_each(r.withColumn("status_and_reason", F.concat_ws("/", "status", "reason")), ["corpus", "book", "status", "status_and_reason"], [F.count("*").alias("n_runs"), F.sum("n").alias("n_words"), F.countDistinct("shared_id").alias("n_addresses")])


def address_conflicts(resolved: DataFrame) -> DataFrame:
    """Addresses that point to more than one node."""
    return resolved.where("shared_id IS NOT NULL").groupBy("shared_id").agg(F.countDistinct("node").alias("n_nodes")).where("n_nodes > 1")


def status_examples(resolved: DataFrame, most: int = 3) -> DataFrame:
    """The smallest records for each status and reason."""
    return smallest(resolved, ["status", "reason"], REC, most)


def uncovered_words(resolved: DataFrame, words: DataFrame) -> DataFrame:
    """Words in no run or in several; empty if the runs divide every record."""
    r = resolved.select(F.col(REC).alias("__r"), "first", "last")
    j = words.select(REC, "ordinal").join(r, (F.col(REC) == F.col("__r")) & F.col("ordinal").between(F.col("first"), F.col("last")), "left")
    return j.groupBy(REC, "ordinal").agg(F.count("first").alias("n_runs")).where("n_runs != 1")


def verse_markers(events: DataFrame, tag: str = "verse_n") -> DataFrame:
    """Verse openings in order, with the chapter they stand in and how many words come before."""
    w = Window.partitionBy(REC).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = ~F.col("closing")
    e = events.withColumn("n_words", F.sum(F.when(opening & (F.col("name") == "norm"), 1).otherwise(0)).over(w))
    e = e.withColumn("epoch", F.sum(F.when(opening & (F.col("name") == "chapter_n"), 1).otherwise(0)).over(w))
    literal = F.element_at("attrs", tag)
    return e.where(opening & (F.col("name") == tag)).select(REC, "seq", "epoch", "n_words", literal.alias("literal"), positive_int(literal).cast("bigint").alias("number"), invalid_literal(literal).alias("invalid"))


def marker_topology(events: DataFrame) -> DataFrame:
    """Each verse opening with how it follows the one before; a chapter begins anew, as does what follows an invalid literal."""
    return topology(verse_markers(events), [REC, "epoch"], ["seq"], "number", words_before="n_words")


def verse_gaps(events: DataFrame, verses: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """Numbers that gaps leave out; with verses (book, chapter, verse) and addresses (record, book, chapter) also whether the other corpus has them."""
    gaps = missing_numbers(marker_topology(events), "number").select(REC, "epoch", "seq", "before", "number", "missing")
    if verses is None or addresses is None:
        return gaps
    v = verses.select("book", "chapter", F.col("verse").alias("missing"), F.lit(True).alias("present")).distinct()
    return gaps.join(addresses, REC, "left").join(v, ["book", "chapter", "missing"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def literal_shapes(c: Corpus) -> DataFrame:
    """What forms the source annotations' verse literals have."""
    return c.annotations.groupBy("track", literal_shape(F.col("source_verse_n")).alias("shape")).agg(F.count("*").alias("n"))


def identity(c: Corpus) -> DataFrame:
    """Counts of identity: multiplicity, classes, clean identifiers, witnesses."""
    d = analysis_digests(c)
    row = lambda df, what, key: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), F.col("n").cast("bigint").alias("n"))
    sizes = histogram(d.where("scholarly_id IS NOT NULL"), ["scholarly_id"]).withColumnsRenamed({"size": "key", "n_groups": "n"})
    copies = histogram(d, ["bytes"]).withColumnsRenamed({"size": "key", "n_groups": "n"})
    clean = d.groupBy(F.when(F.col("scholarly_id").isNull(), "none").when(is_clean_cts(F.col("scholarly_id")), "clean").otherwise("malformed").alias("key")).agg(F.count("*").alias("n"))
    quoted = witness_targets(c).agg(F.count("*").alias("n")).withColumn("key", F.lit("quoted"))
    lost = unresolved_witnesses(c).agg(F.count("*").alias("n")).withColumn("key", F.lit("unresolved"))
    return row(sizes, "identity_size", "key").union(row(copies, "byte_copies", "key")).union(row(clean, "identifier", "key")).union(row(quoted, "witness", "key")).union(row(lost, "witness", "key"))


def metadata_census(c: Corpus) -> DataFrame:
    """For each metadata key: records that have it, have it empty, or repeat it with the same or with different values."""
    one = c.documents.select(REC, F.explode("metadata").alias("key", "value"), "metadata_duplicates")
    again = F.element_at("metadata_duplicates", F.col("key"))
    return one.groupBy("key").agg(F.count("*").alias("n_records"), F.count_if(F.trim("value") == "").alias("n_empty"), F.countDistinct("value").alias("n_values"),
                                  F.count_if(again.isNotNull() & (F.size(F.array_distinct(again)) == 1)).alias("n_repeated_equal"), F.count_if(again.isNotNull() & (F.size(F.array_distinct(again)) > 1)).alias("n_repeated_different"))


def missing_metadata(c: Corpus, key: str = "license") -> DataFrame:
    return c.documents.where(F.coalesce(F.trim(F.element_at("metadata", key)), F.lit("")) == "").select(REC)


def tag_census(events: DataFrame) -> DataFrame:
    """For each tag: openings, records, attribute keys, empty values and repeated attributes."""
    o = events.where("name IS NOT NULL AND NOT closing")
    return o.groupBy("name").agg(F.count("*").alias("n_open"), F.countDistinct(REC).alias("n_records"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs"))))).alias("keys"),
                                 F.sum(F.size(F.filter(F.map_values("attrs"), lambda v: v == ""))).alias("n_empty"), F.sum(F.aggregate(F.map_values("repeated"), F.lit(0), lambda a, x: a + F.size(x) - 1)).alias("n_surplus")).withColumn("keys", F.array_distinct("keys"))


def corpus_census(c: Corpus) -> DataFrame:
    """One row: how much of everything."""
    tables = {"documents": c.documents, "words": c.words, "sentences": c.sentences, "orig_groups": c.orig_groups, "norm_groups": c.norm_groups, "origs": c.origs, "layout": c.layout, "entities": c.entities, "translations": c.translations, "annotations": c.annotations}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in tables.items()]
    parts.append(c.entities.where("parent_ordinal IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("nested_entities").alias("table"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def inventory(records: DataFrame, formats: list[str]) -> DataFrame:
    """records: dataset, record, format. Which formats each record comes in, and which are missing."""
    have = records.groupBy("dataset", "record").pivot("format", formats).agg(F.count("*"))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in formats)))
    return have.withColumn("missing", missing)


def layout_kinds() -> list[str]:
    return [*LAYOUT.values(), *(f"{v}_marker" for v in VERSE)]
