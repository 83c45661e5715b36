"""Evidence around verse markers: paired labels, gaps, verse zero, other editions and exception tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfd_letters, positive_int
from ..plans.parse import REC, Corpus
from .audits import verse_markers
from .joins import cascade, lookup
from .references import only


def paired_verses(c: Corpus, layer: str = "verse") -> DataFrame:
    """Words that two layers of labels both cover as a whole: the wrapper's number and the editor's label."""
    a = c.annotations.where(F.col("kind") == layer).select(F.col(REC).alias("__r"), "first_full", "last_full", positive_int(F.col("value")).cast("bigint").alias("number"))
    w = c.words.where("verse_vid IS NOT NULL").join(a, (F.col(REC) == F.col("__r")) & F.col("ordinal").between(F.col("first_full"), F.col("last_full")))
    return w.groupBy(REC, "ordinal", "verse_vid").agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1 AND number IS NOT NULL").drop("n")


def pair_of_span(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """The pair on which all words of a span (record, kind, ordinal, first_full, last_full) agree; null where they do not or one lacks it."""
    s = spans.where("last_full >= first_full").select(F.col(REC).alias("__r"), "kind", F.col("ordinal").alias("span"), F.explode(F.sequence("first_full", "last_full")).alias("word"))
    j = s.join(pairs, (F.col("__r") == F.col(REC)) & (F.col("word") == F.col("ordinal")), "left")
    whole = F.count("number") == F.count("*")
    return j.groupBy(F.col("__r").alias(REC), "kind", "span").agg(F.when(whole, only("number")).alias("number"), F.when(whole, only("verse_vid")).alias("label"))


def gap_context(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: record, marker (from 1), previous, current. Whether those markers follow one another there, and how many words lie between."""
    w = Window.partitionBy(REC).orderBy("seq")
    m = verse_markers(events).withColumns({"marker": F.row_number().over(w), "seen_before": F.lag("number").over(w), "words_between": F.col("n_words") - F.lag("n_words").over(w)})
    out = wanted.join(m.select(REC, "marker", "number", "seen_before", "words_between"), [REC, "marker"], "left")
    status = cascade([("marker_missing", F.col("number").isNull()), ("markers_differ", ~(F.col("seen_before").eqNullSafe(F.col("previous")) & (F.col("number") == F.col("current"))))], "confirmed")
    return out.select(REC, "marker", "previous", "current", "words_between", status.alias("status"))


def verse_zero(events: DataFrame) -> DataFrame:
    """Records with a verse 0: whether it is the only one and comes first, and its words up to the next marker."""
    w = Window.partitionBy(REC).orderBy("seq")
    m = verse_markers(events).withColumns({"place": F.row_number().over(w), "until": F.lead("n_words").over(w), "next": F.lead("literal").over(w)})
    z = m.where("literal = '0'").groupBy(REC).agg(F.count("*").alias("n_zero"), F.min("place").alias("place"), F.min_by(F.struct("n_words", "until", "next"), "seq").alias("at"))
    status = cascade([("several", F.col("n_zero") > 1), ("not_first", F.col("place") > 1), ("no_next", F.col("at.until").isNull()), ("no_words", F.col("at.until") == F.col("at.n_words"))], "superscription")
    return z.select(REC, status.alias("status"), (F.col("at.until") - F.col("at.n_words")).alias("n_words"), F.col("at.next").alias("next"))


def edition_probe(gaps: DataFrame, editions: list[str], verses: DataFrame) -> DataFrame:
    """gaps: record, book, chapter, missing. Which of a few editions have each missing number; none is preferred.

    verses: edition, book, chapter, verse.
    """
    asked = gaps.withColumn("edition", F.explode(F.array(*map(F.lit, editions))))
    v = verses.select("edition", "book", "chapter", F.col("verse").alias("missing")).distinct()
    found = lookup(asked, v, ["edition", "book", "chapter", "missing"])
    return found.groupBy(REC, "book", "chapter", "missing").agg(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("edition")))).alias("present_in"))


def exception_table(rows: DataFrame, table: DataFrame, verses: DataFrame) -> DataFrame:
    """rows and table share the key ``source``; table: source, target (may be null); verses: target. A missing key differs from a null target."""
    r = lookup(rows, table.withColumnRenamed("target", "to"), ["source"], "has_rule")
    r = lookup(r.withColumn("target", F.col("to")), verses.select("target").distinct(), ["target"], "exists")
    status = cascade([("no_rule", ~F.col("has_rule")), ("no_target", F.col("to").isNull()), ("target_absent", ~F.col("exists"))], "target_exists")
    return r.select(*rows.columns, "target", status.alias("status"))


def motif_status(rows: DataFrame, motif_a: list[str], motif_b: list[str]) -> DataFrame:
    """rows: record, first, second (arrays of words of two neighbouring verses). In which of them each motif's words stand, by letters alone."""
    words = rows.select(REC, F.explode(F.array(F.struct(F.lit("first").alias("verse"), F.col("first").alias("w")), F.struct(F.lit("second").alias("verse"), F.col("second").alias("w")))).alias("x")).select(REC, "x.verse", F.explode("x.w").alias("word"))
    words = words.withColumn("word", nfd_letters(F.col("word")))
    has = lambda verse, motif: F.max(F.when((F.col("verse") == verse) & F.col("word").isin(*motif), 1).otherwise(0)) == 1
    g = words.groupBy(REC).agg(has("first", motif_a).alias("a1"), has("second", motif_a).alias("a2"), has("first", motif_b).alias("b1"), has("second", motif_b).alias("b2"))
    c = F.col
    status = cascade([("both_in_both", c("a1") & c("a2") & c("b1") & c("b2")), ("same_numbering", c("a1") & c("b2") & ~c("a2") & ~c("b1")), ("shifted", c("a2") & c("b1") & ~c("a1") & ~c("b2")), ("merged_in_first", c("a1") & c("b1")), ("merged_in_second", c("a2") & c("b2"))], "inconclusive")
    return g.select(REC, status.alias("status"))
