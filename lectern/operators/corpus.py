"""Questions to a graph: features, edges, containment, sections, text and provenance."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph, digest
from ..plans.parse import REC


class MissingFeature(KeyError):
    """A feature that this corpus does not have."""


class Query:
    """Answers are DataFrames; nothing is computed before an action."""

    def __init__(self, graph: Graph, repository: str = "", revision: str = ""):
        self.g, self.repository, self.revision = graph, repository, revision

    def _need(self, df: DataFrame, *features: str) -> None:
        for f in features:
            if f not in df.columns:
                raise MissingFeature(f)

    def words(self, **features) -> DataFrame:
        """Words that have all the given values; at least one is required."""
        if not features:
            raise ValueError("at least one feature is required")
        self._need(self.g.slots, *features)
        return self.g.slots.where(functools.reduce(operator.and_, (F.col(k) == F.lit(v) for k, v in features.items())))

    def ud_words(self, feats: dict[str, str] | None = None, **features) -> DataFrame:
        out = self.words(**{f"ud_{k}": v for k, v in features.items()}) if features else self.g.slots
        for k, v in (feats or {}).items():
            out = out.where(F.element_at("ud_feats", k) == v)
        return out

    def nodes(self, otype: str, **features) -> DataFrame:
        out = self.g.nodes.where(F.col("otype") == otype)
        self._need(out, *features)
        return functools.reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), features.items(), out)

    def edges(self, kind: str) -> DataFrame:
        return self.g.edges.where(F.col("kind") == kind)

    def outgoing(self, kind: str, nodes: DataFrame) -> DataFrame:
        return self.edges(kind).join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi")

    def incoming(self, kind: str, nodes: DataFrame) -> DataFrame:
        return self.edges(kind).join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")

    def pairs(self, kind: str, source: DataFrame, target: DataFrame) -> DataFrame:
        """(src, dst) node pairs along an edge, columns in the order asked for."""
        e = self.edges(kind).select("src", "dst")
        return e.join(source.select(F.col("node_id").alias("src")), "src", "left_semi").join(target.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")

    def dependency_pairs(self, func: str | None = None, ud: bool = False) -> DataFrame:
        source = self.g.slots if func is None else self.words(**{"ud_deprel" if ud else "func": func})
        return self.pairs("ud_head" if ud else "dependency_head", source, self.g.slots)

    def entity_heads(self, entity_class: str | None = None) -> DataFrame:
        """Entities with their head word, and the words they hold."""
        e = self.nodes("entity") if entity_class is None else self.nodes("entity", entity_class=entity_class)
        heads = self.edges("entity_head").select(F.col("src").alias("node_id"), F.col("dst").alias("head_word"))
        return e.join(heads, "node_id").select("node_id", REC, "entity_class", "identity", "head_word", "first_slot", "last_slot")

    def held(self, nodes: DataFrame) -> DataFrame:
        """(node_id, word) for each word that a node holds; a record's words meet only its own nodes."""
        n = nodes.select("node_id", F.explode(F.sequence("first_slot", "last_slot")).alias("word"))
        return n.join(self.g.slots.select(F.col("node_id").alias("word"), "ordinal", "source_text"), "word")

    def section_of(self, nodes: DataFrame) -> DataFrame:
        d = self.nodes("document").select(F.col("node_id").alias("document_node"), REC)
        return nodes.select("node_id", REC).join(d, REC)

    def section(self, record: str) -> DataFrame:
        return self.nodes("document").where(F.col(REC) == record)

    def documents(self, **features) -> DataFrame:
        return functools.reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), features.items(), self.g.documents)

    def identity(self, record: str) -> DataFrame:
        return self.g.documents.where(F.col(REC) == record).select(REC, "scholarly_id")

    def relations(self, kind: str) -> DataFrame:
        d = self.nodes("document").select("node_id", REC)
        e = self.edges(kind)
        return e.join(d.withColumnsRenamed({"node_id": "src", REC: "source_record"}), "src").join(d.withColumnsRenamed({"node_id": "dst", REC: "target_record"}), "dst")

    def views(self, rank: DataFrame | None = None) -> DataFrame:
        """(view, source_record_id): all records; one of each set of equal bytes; one of each identity; and of each identity the one of the greatest rank.

        rank: source_record_id and rank. The least id stands for its group. No view changes the corpus.
        """
        d = self.g.documents.select(REC, F.sha2("content", 256).alias("bytes"), F.coalesce("scholarly_id", REC).alias("identity"))
        ranked = d.join(rank, REC, "left") if rank is not None else d.withColumn("rank", F.lit(None).cast("int"))
        one = lambda view, df: df.select(F.lit(view).alias("view"), REC)
        best = ranked.groupBy("identity").agg(F.min_by(REC, F.struct(F.coalesce(F.negative("rank"), F.lit(2**31 - 1)), REC)).alias(REC))
        return one("all", d).union(one("nonredundant", d.groupBy("bytes").agg(F.min(REC).alias(REC)))).union(one("source_preferred", d.groupBy("identity").agg(F.min(REC).alias(REC)))).union(one("best_parsing", best))

    def text(self, feature: str = "source_text", separator: str = " ") -> DataFrame:
        """Each record's text from one feature of its words, in order."""
        self._need(self.g.slots, feature)
        pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.coalesce(feature, F.lit("")).alias("t")))), lambda x: x["t"]), separator)
        return self.g.slots.groupBy(REC).agg(pieces.alias("text"))

    def own_text(self) -> DataFrame:
        """What nodes say of themselves: translations and layout their text, groups their value."""
        return self.g.nodes.select("node_id", "otype", F.when(F.col("otype").isin("orig_group", "norm_group", "orig"), F.col("value")).otherwise(F.col("text")).alias("text")).where("text IS NOT NULL")

    def provenance(self, nodes: DataFrame) -> DataFrame:
        """From nodes to their record, its file and the revision it came from."""
        meta = [c for c in ("source_path", "packaging", "source_sha256", "corpus", "dataset", "record") if c in self.g.documents.columns]
        out = nodes.select("node_id", REC).join(self.g.documents.select(REC, "scholarly_id", *meta), REC)
        return out.withColumns({"repository": F.lit(self.repository), "revision": F.lit(self.revision)})

    def with_overlay(self, overlay: DataFrame, fingerprint: str) -> DataFrame:
        """Words with an overlay's features by node id; fingerprint: the digest of the graph it was made for.

        Refused unless this graph's own digest, computed anew, is the same.
        """
        if digest(self.g).collect()[0][0] != fingerprint:  # one row
            raise ValueError("the overlay belongs to another graph")
        return self.g.slots.join(overlay, "node_id", "left")

    def inventory(self) -> DataFrame:
        """Features with how many words have them."""
        plain = [c for c, t in self.g.slots.dtypes if c not in ("node_id",)]
        counts = self.g.slots.agg(*(F.count(c).alias(c) for c in plain))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in plain))).alias("x")).select("x.*")
