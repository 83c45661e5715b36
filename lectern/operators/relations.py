"""How records relate: one identity, declared overlap, quoted witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..plans.parse import REC, Corpus
from .joins import cascade

# Records of two datasets that hold the same chapters: (left dataset, left prefix, right dataset, right prefix, last chapter).
DECLARED = (
    ("sahidica.mark/sahidica.mark", "Mark_", "sahidica.nt/sahidica.nt", "41_Mark_", 16),
    ("sahidica.1corinthians/sahidica.1corinthians", "1Cor_", "sahidica.nt/sahidica.nt", "46_1_Corinthians_", 16),
    ("sahidic.ruth/sahidic.ruth", "Ruth_", "sahidic.ot/sahidic.ot", "08_Ruth_", 4),
)
KINDS = ("byte_identical", "textual_divergence", "alternate_analysis", "core_identical_source_variant")


def analysis_digests(c: Corpus) -> DataFrame:
    """Per record: its bytes, its text and its analysis, as digests that can be compared across records."""
    def ordered(*columns):
        return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", *columns)))), 256)

    w = c.words.groupBy(REC).agg(ordered("norm").alias("text"), ordered("norm", "lemma", "pos", "func", "head_ordinal").alias("analysis"))
    o = c.origs.withColumn("ordinal", F.col("index")).groupBy(REC).agg(ordered("value").alias("origs"))
    d = c.documents.select(REC, "scholarly_id", F.sha2("content", 256).alias("bytes"), casefold(REC).alias("fold"))
    return d.join(w, REC, "left").join(o, REC, "left")


def classification(left: str, right: str):
    """The first that holds: same bytes, other text, other analysis, same core."""
    differ = lambda f: ~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}"))
    return cascade([(KINDS[0], ~differ("bytes")), (KINDS[1], differ("text") | differ("origs")), (KINDS[2], differ("analysis"))], KINDS[3])


def derive_relations(c: Corpus) -> DataFrame:
    """kind, source_record_id, target_record_id and evidence of all three kinds of relation."""
    d = analysis_digests(c)
    empty = F.lit(None).cast("string")
    before = (F.col("a.fold") < F.col("b.fold")) | ((F.col("a.fold") == F.col("b.fold")) & (F.col(f"a.{REC}") < F.col(f"b.{REC}")))
    # The contract asks for every pair of one identity; identities name a work, so their groups are small.
    same = d.alias("a").join(d.alias("b"), (F.col("a.scholarly_id") == F.col("b.scholarly_id")) & before)
    same = same.select(F.lit("same_scholarly").alias("kind"), F.col(f"a.{REC}").alias(REC), F.col(f"b.{REC}").alias("target_record_id"), classification("a", "b").alias("classification"), empty.alias("family"), empty.alias("witness_literal"), empty.alias("target_id"))
    pairs = [(f"{ls}:{lp}{n:02d}", f"{rs}:{rp}{n:02d}", "book_aggregate") for ls, lp, rs, rp, last in DECLARED for n in range(1, last + 1)]
    spark = c.words.sparkSession
    declared = F.broadcast(spark.createDataFrame(pairs, "l string, r string, family string"))
    over = declared.join(d.alias("a"), F.col("l") == F.col(f"a.{REC}")).join(d.alias("b"), F.col("r") == F.col(f"b.{REC}"))
    over = over.select(F.lit("documented_overlap").alias("kind"), F.col(f"a.{REC}").alias(REC), F.col(f"b.{REC}").alias("target_record_id"), classification("a", "b").alias("classification"), "family", empty.alias("witness_literal"), empty.alias("target_id"))
    w = witness_targets(c)
    wit = w.join(d.select(F.col("scholarly_id").alias("target_id"), F.col(REC).alias("target_record_id")), "target_id")
    wit = wit.select(F.lit("witness").alias("kind"), REC, "target_record_id", empty.alias("classification"), empty.alias("family"), "witness_literal", "target_id")
    return same.union(over).union(wit)


def witness_targets(c: Corpus) -> DataFrame:
    """Identities quoted in a record's witness metadata, each once."""
    text = F.element_at("metadata", "witness")
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(urn:cts:\S+)"), F.lit(1)), lambda t: F.rtrim(t, F.lit(".,;!?)]}"))))
    return c.documents.where(text.isNotNull()).select(REC, text.alias("witness_literal"), F.explode(found).alias("target_id"))


def unresolved_witnesses(c: Corpus) -> DataFrame:
    """Quoted identities that no record has."""
    known = c.documents.select(F.col("scholarly_id").alias("target_id")).where("target_id IS NOT NULL").distinct()
    return witness_targets(c).join(known, "target_id", "left_anti")
