"""From corpus tables to a property graph: dense node ids, edges, ranges and checks.

Words are nodes 1..N in (record, ordinal) order; all other nodes follow, ordered by
node type, record and ordinal. Ids come from prefix sums over the counts of each
(type, record), never from a sort of all nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..functions.vocabulary import LAYOUT, NODE_TYPES
from ..operators.ids import running_offsets
from ..tables import written
from .parse import REC, Corpus, IntegrityError

#: What a node's rendering is made of.
SPAN, ANCHOR, OWN_TEXT = "span", "anchor", "own_text"


@dataclass
class Graph:
    slots: DataFrame  # node_id, source_record_id, ordinal and the word's columns
    nodes: DataFrame  # node_id, otype, source_record_id, source_ordinal, first_slot, last_slot, ...
    edges: DataFrame  # kind, src, dst and evidence
    documents: DataFrame
    violations: DataFrame

    def strict(self) -> Graph:
        bad = self.violations.orderBy("rule", "key").take(1)
        if bad:
            raise IntegrityError(f"{bad[0]['rule']}: {bad[0]['key']} {bad[0]['detail']}")
        return self

    def ranges(self) -> DataFrame:
        """The interval of ids of each node type."""
        return self.nodes.groupBy("otype").agg(F.min("node_id").alias("start"), F.max("node_id").alias("end"), F.count("*").alias("n"))

    def census(self) -> DataFrame:
        """How many nodes of each type, edges of each kind, and spans of each width."""
        width = F.col("last_slot") - F.col("first_slot") + 1
        parts = [self.nodes.groupBy(F.lit("node").alias("what"), F.col("otype").alias("key")).agg(F.count("*").alias("n")),
                 self.edges.groupBy(F.lit("edge").alias("what"), F.col("kind").alias("key")).agg(F.count("*").alias("n")),
                 self.nodes.groupBy(F.lit("width").alias("what"), width.cast("string").alias("key")).agg(F.count("*").alias("n"))]
        return parts[0].union(parts[1]).union(parts[2])


def layout_segments(layout: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Each layout event's stretch, up to the next of its kind: words it holds characters of, and that text.

    A stretch without characters is anchored at the word next to it, with empty text.
    """
    at = F.struct(F.coalesce("word_ordinal", F.col("after_word_ordinal") + 1).alias("w"), F.coalesce("char_offset", F.lit(0)).alias("c"))
    events = layout.where(F.col("kind").isin(*LAYOUT.values())).join(totals, REC).withColumn("at", at)
    w = Window.partitionBy(REC, "kind").orderBy("ordinal")
    events = events.withColumn("until", F.coalesce(F.lead("at").over(w), F.struct((F.col("n_words") + 1).cast("int").alias("w"), F.lit(0).alias("c"))))
    pieces = events.alias("e").join(words.select(F.col(REC).alias("__r"), F.col("ordinal").alias("__w"), "source_text").alias("x"), (F.col(f"e.{REC}") == F.col("__r")) & F.col("__w").between(F.col("at.w"), F.col("until.w")), "left")
    low = F.when(F.col("__w") == F.col("at.w"), F.col("at.c")).otherwise(0)
    high = F.when(F.col("__w") == F.col("until.w"), F.col("until.c")).otherwise(F.length("source_text"))
    pieces = pieces.withColumns({"lo": low, "hi": high})
    held = F.col("hi") > F.col("lo")
    part = F.when(held, F.struct("__w", F.substring("source_text", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "")
    g = pieces.groupBy(REC, "kind", "ordinal", "value", "at", "n_words").agg(text.alias("text"), F.min(F.when(held, F.col("__w"))).alias("first"), F.max(F.when(held, F.col("__w"))).alias("last"))
    anchor = F.least(F.greatest(F.col("at.w"), F.lit(1)), F.col("n_words").cast("int"))
    return g.select(REC, F.col("kind").alias("otype"), "ordinal", F.coalesce("first", anchor).alias("first"), F.coalesce("last", anchor).alias("last"), F.col("value").alias("label"), "text")


def _common(df: DataFrame, otype: Column, ordinal: str, first: Column, last: Column, **more: Column) -> DataFrame:
    fields = {"value": "string", "label": "string", "text": "string", "identity": "string", "entity_class": "string", "render_mode": "string", "parent_type": "string", "parent_ordinal": "int", "head_ordinal": "int"}
    extra = [more.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields.items()]
    attributes = more.get("source_attributes", F.lit(None)).cast("map<string,string>").alias("source_attributes")
    return df.select(REC, otype.alias("otype"), F.col(ordinal).cast("int").alias("source_ordinal"), first.cast("int").alias("first"), last.cast("int").alias("last"), *extra, attributes)


def _node_rows(c: Corpus, totals: DataFrame) -> DataFrame:
    lit, col = F.lit, F.col
    out = [_common(totals, lit("document"), "one", lit(1), col("n_words"))]
    out.append(_common(c.sentences, lit("sentence"), "ordinal", col("first"), col("last")))
    loci = {"norm_group": "norm_group_index", "orig": "orig_index"}
    groups = {"orig_group": c.orig_groups, "norm_group": c.norm_groups, "orig": c.origs}
    word_groups = c.words.join(c.norm_groups.select(REC, col("index").alias("norm_group_index"), col("parent_index").alias("orig_group_index")), [REC, "norm_group_index"], "left")
    loci["orig_group"] = "orig_group_index"
    for name, table in groups.items():
        span = word_groups.where(col(loci[name]).isNotNull()).groupBy(REC, col(loci[name]).alias("index")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
        parent = {"norm_group": "orig_group", "orig": "norm_group"}.get(name)
        t = table.join(span, [REC, "index"], "left").withColumn("ordinal", col("index") + 1)
        out.append(_common(t, lit(name), "ordinal", col("first"), col("last"), value=col("value"), parent_type=F.when(col("parent_index").isNotNull(), lit(parent)), parent_ordinal=col("parent_index") + 1))
    seg = layout_segments(c.layout, c.words, totals)
    out.append(_common(seg, col("otype"), "ordinal", col("first"), col("last"), label=col("label"), text=col("text"), render_mode=lit(OWN_TEXT)))
    marks = c.layout.where(col("kind").endswith("_marker"))
    out.append(_common(marks, col("kind"), "ordinal", col("word_ordinal"), col("word_ordinal"), label=col("value")))
    out.append(_common(c.entities, lit("entity"), "ordinal", col("first"), col("last"), entity_class=col("entity_class"), identity=col("identity"), parent_type=F.when(col("parent_ordinal").isNotNull(), lit("entity")), parent_ordinal=col("parent_ordinal"), head_ordinal=col("head_ordinal"), source_attributes=F.when(col("source_text_literal").isNotNull(), F.create_map(lit("text"), col("source_text_literal")))))
    out.append(_common(c.translations, col("otype"), "ordinal", col("first"), col("last"), text=col("text"), render_mode=lit(OWN_TEXT)))
    a = c.annotations.join(totals, REC)
    whole = col("last_full") >= col("first_full")
    anchor = F.least(col("n_words"), col("start_after") + 1)
    out.append(_common(a, col("kind"), "ordinal", F.when(whole, col("first_full")).otherwise(anchor), F.when(whole, col("last_full")).otherwise(anchor), value=col("value"), label=col("source_verse_n"), render_mode=F.concat(col("track"), F.when(whole & (col("track") != "token"), lit("_" + SPAN)).otherwise(lit("_" + ANCHOR))), source_attributes=col("source_attributes")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def build_graph(c: Corpus, relations: DataFrame | None = None) -> Graph:
    """relations: kind, source_record_id, target_record_id, classification, family, witness_literal, target_id."""
    counts = c.words.groupBy(REC).agg(F.count("*").alias("n_words"))
    totals = c.documents.select(REC, "scholarly_id").join(counts, REC, "left").select(REC, "scholarly_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.lit(1).alias("one"), casefold(REC).alias("fold"))
    totals = written(totals, "totals")
    starts = written(running_offsets(totals, ["fold", REC], "n_words").select(REC, "n_words", F.col("__before").alias("slot_start")), "starts")
    slots = c.words.join(starts.select(REC, "slot_start"), REC).withColumn("node_id", F.col("slot_start") + F.col("ordinal"))
    rows = _node_rows(c, totals)
    rank = F.element_at(F.create_map(*(x for i, t in enumerate(NODE_TYPES) for x in (F.lit(t), F.lit(i)))), F.col("otype"))
    rows = rows.withColumn("rank", rank).withColumn("within", F.row_number().over(Window.partitionBy(REC, "otype").orderBy("source_ordinal")))
    rows = written(rows, "rows")
    blocks = rows.groupBy("rank", "otype", REC).agg(F.count("*").alias("n")).join(totals.select(REC, "fold"), REC)
    blocks = running_offsets(blocks, ["rank", "fold", REC], "n").select("otype", REC, F.col("__before").alias("block_start"))
    n_slots = c.words.agg(F.count("*").alias("n_slots"))
    nodes = rows.join(blocks, ["otype", REC]).join(starts.select(REC, "slot_start"), REC).crossJoin(F.broadcast(n_slots))
    nodes = nodes.withColumns({"node_id": F.col("n_slots") + F.col("block_start") + F.col("within"), "first_slot": F.col("slot_start") + F.col("first"), "last_slot": F.col("slot_start") + F.col("last")})
    slots, nodes = written(slots, "slots"), written(nodes, "nodes")
    head = lambda kind, df, src, dst: df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))
    edges = head("dependency_head", slots.where("head_ordinal > 0"), F.col("node_id"), F.col("slot_start") + F.col("head_ordinal"))
    edges = edges.union(head("entity_head", nodes.where("otype = 'entity' AND head_ordinal IS NOT NULL"), F.col("node_id"), F.col("slot_start") + F.col("head_ordinal")))
    if "ud_head" in c.words.columns:
        edges = edges.union(head("ud_head", slots.where("ud_head > 0"), F.col("node_id"), F.col("slot_start") + F.col("ud_head")))
    up = nodes.select(F.col(REC).alias("__r"), F.col("otype").alias("__t"), F.col("source_ordinal").alias("__o"), F.col("node_id").alias("__parent"))
    child = nodes.join(up, (F.col(REC) == F.col("__r")) & (F.col("parent_type") == F.col("__t")) & (F.col("parent_ordinal") == F.col("__o")))
    edges = edges.union(head("parent", child, F.col("node_id"), F.col("__parent")))
    direct = slots.where("orig_index IS NULL AND norm_group_index IS NOT NULL").join(up.where("__t = 'norm_group'"), (F.col(REC) == F.col("__r")) & (F.col("norm_group_index") + 1 == F.col("__o")))
    edges = edges.union(head("direct_word", direct, F.col("__parent"), F.col("node_id")))
    evidence = ("classification", "family", "witness_literal", "target_id")
    edges = edges.select("*", *(F.lit(None).cast("string").alias(e) for e in evidence))
    if relations is not None:
        d = nodes.where("otype = 'document'").select(F.col(REC).alias("__r"), F.col("node_id").alias("__n"))
        r = relations.join(d.withColumnsRenamed({"__r": REC, "__n": "src"}), REC, "left").join(d.withColumnsRenamed({"__r": "target_record_id", "__n": "dst"}), "target_record_id", "left")
        edges = edges.unionByName(r.select("kind", "src", "dst", *evidence))
    edges = written(edges, "edges")
    slots, nodes = slots.drop("seq"), nodes.drop("rank", "within", "block_start", "n_slots", "first", "last", "head_ordinal", "parent_type", "parent_ordinal", "slot_start")
    return Graph(slots, nodes, edges, c.documents, validate(slots, nodes, edges))


def validate(slots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (rule, key, detail) for whatever a graph must not have."""
    def rule(df: DataFrame, name: str, key: Column, detail: Column | None = None) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))

    ids = slots.select("node_id").union(nodes.select("node_id"))
    out = [rule(ids.groupBy("node_id").count().where("count > 1"), "duplicate_node_id", F.col("node_id"))]
    out.append(rule(ids.agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"), F.count("*").alias("n")).where("n > 0 AND (lo != 1 OR hi != n)"), "ids_not_dense", F.col("hi"), F.col("n")))
    out.append(rule(nodes.where(~F.col("otype").isin(*NODE_TYPES)), "unknown_type", F.col("node_id"), F.col("otype")))
    out.append(rule(nodes.where("first_slot IS NULL OR last_slot < first_slot"), "node_without_slots", F.col("node_id"), F.col("otype")))
    bound = slots.groupBy(REC).agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    out.append(rule(nodes.join(bound, REC).where("first_slot < lo OR last_slot > hi"), "slots_outside_record", F.col("node_id"), F.col("otype")))
    out.append(rule(nodes.where("otype = 'document'").groupBy(REC).count().where("count > 1"), "several_documents", F.col(REC)))
    known = ids.select(F.col("node_id").alias("__n"))
    for end in ("src", "dst"):
        out.append(rule(edges.join(known, F.col(end) == F.col("__n"), "left_anti"), f"edge_{end}_unknown", F.col("kind"), F.col(end)))
    out.append(rule(edges.groupBy(*edges.columns).count().where("count > 1"), "duplicate_edge", F.col("kind"), F.col("src")))
    words = slots.select(F.col("node_id").alias("__w"))
    out.append(rule(edges.where(F.col("kind").isin("dependency_head", "ud_head")).join(words, F.col("src") == F.col("__w"), "left_anti"), "word_edge_from_node", F.col("kind"), F.col("src")))
    own = F.col("classification").isNull() & F.col("kind").isin("same_scholarly", "documented_overlap") | (F.col("kind") == "documented_overlap") & F.col("family").isNull() | (F.col("kind") == "witness") & (F.col("witness_literal").isNull() | F.col("target_id").isNull())
    out.append(rule(edges.where(own), "relation_without_evidence", F.col("kind"), F.col("src")))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def surface(slots: DataFrame, groups: DataFrame) -> DataFrame:
    """node_id, surface and separator: a group's value on its first word and nothing on its others; the separator at a group's end.

    groups: nodes of types orig and orig_group; where both cover a word, the later node wins.
    """
    g = groups.where(F.col("otype").isin("orig", "orig_group") & F.col("value").isNotNull()).select(F.col("node_id").alias("g"), "first_slot", "last_slot", "value", "otype", F.col(REC).alias("__r"))
    j = slots.select("node_id", REC, "source_text").join(g, (F.col(REC) == F.col("__r")) & F.col("node_id").between(F.col("first_slot"), F.col("last_slot")), "left")
    shown = F.max_by(F.struct(F.when(F.col("node_id") == F.col("first_slot"), F.col("value")).otherwise("").alias("s")), F.when(F.col("g").isNotNull(), F.col("g")))
    inner = F.max(F.coalesce((F.col("otype") == "orig_group") & (F.col("node_id") < F.col("last_slot")), F.lit(False)))
    return j.groupBy("node_id", REC).agg(F.coalesce(shown["s"], F.first("source_text")).alias("surface"), F.when(inner, "").otherwise(" ").alias("separator"))


def digest(g: Graph) -> DataFrame:
    """One row: a digest of slots, nodes and edges that does not depend on order or partitions."""
    def part(df: DataFrame, name: str) -> DataFrame:
        cols = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
        h = [F.xxhash64(*cols), F.xxhash64(*cols, F.lit("second"))]
        return df.agg(F.concat_ws("-", F.count("*").cast("string"), *(F.lower(F.hex(F.bit_xor(x))) for x in h)).alias(name))

    return part(g.slots, "slots").crossJoin(part(g.nodes, "nodes")).crossJoin(part(g.edges, "edges")).select(F.sha2(F.concat_ws("|", "slots", "nodes", "edges"), 256).alias("fingerprint"))
