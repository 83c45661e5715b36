"""Queries that run the corpus engine itself on annotated records, with equivalent SQL.

Every benchmark item is written as a record with all kinds of markup, and is parsed, related,
resolved and built to a graph by the library; the SQL works out the same from the item's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audits
from .operators.corpus import Query
from .operators.references import resolve_runs, verse_overlay, witnesses, word_overlay
from .operators.relations import derive_relations
from .plans.graph import build_graph, surface
from .plans.parse import REC, parse_records
from .registry import _ITEMS_SQL, WORDS, load, long, query
from .sources.conllu import supplement
from .sources.markup import tag_events

#: Words in a verse, in a group, in a line; a verse whose number modulo this is left has no number.
VERSE, GROUP, LINE, UNNUMBERED = 6, 4, 7, 3


def _items(spark, sf_dir) -> DataFrame:
    w = F.filter(F.transform(F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1)), lambda x: F.regexp_replace(x, '[<>"&]', "")), lambda x: x != "")
    return load(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", w.alias("w")).where(F.size("w") > 0)


def _id(c) -> F.Column:
    return F.lpad(c.cast("string"), 8, "0")


def _text(value) -> F.Column:
    return value.cast("string")


def records(spark, sf_dir) -> DataFrame:
    """Words in groups, verses, lines, notes and entities, under one translation, with heads, lemmas and parts of speech."""
    n = F.size("w")

    def word(x, i):
        first, last = (lambda every: i % every == 0), (lambda every: (i % every == every - 1) | (i + 1 == n))
        sentence = (i == 0) | F.coalesce(F.get("w", i - 1).endswith("."), F.lit(False))
        number = F.when(F.floor(i / VERSE) % 4 == UNNUMBERED, F.lit("x")).otherwise(_text(F.floor(i / VERSE) + 1))
        head = F.when(i == 0, F.lit('func="root"')).otherwise(F.concat(F.lit('func="dep" head="#u'), _text(i), F.lit('"')))
        norm = F.concat(F.lit('<norm xml:id="u'), _text(i + 1), F.lit('" lemma="l'), _text(F.length(x) % 5), F.when(i % 2 == 0, '" pos="N" ').otherwise('" pos="V" '), F.when(sentence, 'new_sent="true" ').otherwise(""), head, F.lit(' norm="'), F.lower(x), F.lit('">'), x, F.lit("</norm>"))
        return F.concat(
            F.when(first(GROUP), F.concat(F.lit('<orig_group orig_group="G'), _text(F.floor(i / GROUP)), F.lit('"><norm_group norm_group="g">'))).otherwise(""),
            F.when(first(VERSE), F.concat(F.lit('<verse_n verse_n="'), number, F.lit('">'))).otherwise(""), F.when(first(LINE), F.concat(F.lit('<lb_n lb_n="'), _text(F.floor(i / LINE)), F.lit('">'))).otherwise(""),
            F.when(i % 10 == 2, F.concat(F.lit('<entity entity="person" head_tok="#u'), _text(i + 1), F.lit('">'))).otherwise(""),
            F.when(i % 3 == 1, F.concat(F.lit('<orig orig="O'), _text(i), F.lit('">'), norm, F.lit("</orig>"))).otherwise(norm),
            F.when((i % 10 == 3) | ((i % 10 == 2) & (i + 1 == n)), "</entity>").otherwise(""), F.when(last(VERSE), "</verse_n>").otherwise(""), F.when(last(GROUP), "</norm_group></orig_group>").otherwise(""))

    family = F.floor(F.col("item_id") / 3)
    chapter = _text(family % 4 + 1)
    meta = F.concat(F.lit('<meta document_cts_urn="urn:cts:copticLit:ot.ruth.ed'), _text(family), F.lit(":"), chapter, F.lit('" chapter="'), chapter, F.when(F.col("item_id") % 5 == 0, '" book="Jonah">').otherwise('" book="Ruth">'))
    content = F.concat(meta, F.lit('<translation translation="t">'), F.array_join(F.transform("w", word), "\n"), F.lit("</translation>"))
    corpus = F.when(F.col("item_id") % 7 == 0, "other").otherwise("sahidic.ruth")
    return _items(spark, sf_dir).select(_id(F.col("item_id")).alias(REC), corpus.alias("corpus"), F.encode(content, "utf-8").alias("content"))


def corpus(spark, sf_dir):
    return parse_records(records(spark, sf_dir))


def graph(spark, sf_dir):
    return build_graph(corpus(spark, sf_dir))



def _item_id() -> F.Column:
    return long(REC).alias("item_id")


_N_SQL = f"{_ITEMS_SQL}, n AS (SELECT item_id, max(ordinal) AS n FROM s GROUP BY item_id), g AS (SELECT s.*, n.n, ordinal - 1 AS i FROM s JOIN n USING (item_id))"


def _words(df: DataFrame) -> DataFrame:
    return df.select(_item_id(), long("ordinal").alias("ordinal"))


# Questions to a graph

@query(f"WITH {_N_SQL} SELECT item_id, ordinal FROM g WHERE length(word) % 5 = 3")
def lemma_filter(spark, sf_dir):
    return _words(Query(graph(spark, sf_dir)).words(lemma="l3"))


@query(f"WITH {_N_SQL} SELECT item_id, ordinal FROM g WHERE i % 2 = 1 AND i > 0 AND length(word) % 5 = 2")
def morph_filter(spark, sf_dir):
    return _words(Query(graph(spark, sf_dir)).words(pos="V", func="dep", lemma="l2"))


@query(f"WITH {_N_SQL} SELECT item_id FROM n WHERE item_id % 7 = 0")
def document_filter(spark, sf_dir):
    return Query(graph(spark, sf_dir)).documents(corpus="other").select(_item_id())


@query(f"WITH {_N_SQL} SELECT item_id, sha256(string_agg(word, ' ' ORDER BY ordinal)) AS rendered FROM g GROUP BY item_id")
def text_render(spark, sf_dir):
    return Query(graph(spark, sf_dir)).text().select(_item_id(), F.sha2("text", 256).alias("rendered"))


_ENTITIES_SQL = "e AS (SELECT item_id, i, i // 10 + 1 AS entity, i + 1 AS first_word, least(i + 2, n) AS last_word FROM g WHERE i % 10 = 2)"


@query(f"WITH {_N_SQL}, {_ENTITIES_SQL} SELECT item_id, CAST(entity AS BIGINT) AS entity, first_word AS head_word, first_word, last_word FROM e")
def entity_heads(spark, sf_dir):
    """Entities with their head word and the words they cover, by ordinals in the record."""
    g = graph(spark, sf_dir)
    first = g.nodes.where("otype = 'document'").select(REC, F.col("first_slot").alias("zero"))
    e = Query(g).entity_heads("person").join(first, REC).join(g.nodes.select("node_id", "source_ordinal"), "node_id")
    at = lambda c: long(F.col(c) - F.col("zero") + 1).alias
    return e.select(_item_id(), long("source_ordinal").alias("entity"), at("head_word")("head_word"), at("first_slot")("first_word"), at("last_slot")("last_word"))


@query(f"WITH {_N_SQL}, {_ENTITIES_SQL} SELECT e.item_id, CAST(e.entity AS BIGINT) AS entity, g.ordinal, g.word AS source_text FROM e JOIN g ON g.item_id = e.item_id AND g.ordinal BETWEEN e.first_word AND e.last_word")
def held_words(spark, sf_dir):
    q = Query(graph(spark, sf_dir))
    e = q.nodes("entity")
    return q.held(e).join(e.select("node_id", REC, "source_ordinal"), "node_id").select(_item_id(), long("source_ordinal").alias("entity"), long("ordinal").alias("ordinal"), "source_text")


@query(f"WITH {_N_SQL} SELECT a.item_id, a.ordinal AS src, b.ordinal AS dst FROM g a JOIN g b ON a.item_id = b.item_id AND b.ordinal = a.ordinal - 1")
def dependency_pairs(spark, sf_dir):
    g = graph(spark, sf_dir)
    at = lambda s: g.slots.select(F.col("node_id").alias(s), *([REC] if s == "src" else []), long("ordinal").alias(f"{s}_ordinal"))
    return Query(g).dependency_pairs("dep").join(at("src"), "src").join(at("dst"), "dst").select(_item_id(), F.col("src_ordinal").alias("src"), F.col("dst_ordinal").alias("dst"))


@query(f"""WITH {_N_SQL}, t AS (SELECT item_id, any_value(n) AS n FROM g GROUP BY item_id)
SELECT item_id, 'document' AS otype, CAST(1 AS BIGINT) AS n_nodes FROM t UNION ALL SELECT item_id, 'translation', 1 FROM t
UNION ALL SELECT item_id, 'sentence', CAST(max(sentence) AS BIGINT) FROM g GROUP BY item_id UNION ALL SELECT item_id, 'orig', count(*) FROM g WHERE i % 3 = 1 GROUP BY item_id
UNION ALL SELECT item_id, 'orig_group', (n + {GROUP - 1}) // {GROUP} FROM t UNION ALL SELECT item_id, 'norm_group', (n + {GROUP - 1}) // {GROUP} FROM t
UNION ALL SELECT item_id, 'line', (n + {LINE - 1}) // {LINE} FROM t UNION ALL SELECT item_id, 'entity', count(*) FROM g WHERE i % 10 = 2 GROUP BY item_id""")
def node_census(spark, sf_dir):
    """Nodes of each type in each record, of those that hold words."""
    n = graph(spark, sf_dir).nodes.where("otype NOT LIKE '%marker'")
    return n.groupBy(_item_id(), "otype").agg(F.count("*").alias("n_nodes"))


@query(f"WITH {_N_SQL} SELECT item_id, CAST(i // {LINE} AS VARCHAR) AS label, min(ordinal) AS first_word, max(ordinal) AS last_word, string_agg(word, '' ORDER BY ordinal) AS text FROM g GROUP BY item_id, i // {LINE}")
def layout_lines(spark, sf_dir):
    g = graph(spark, sf_dir)
    zero = g.nodes.where("otype = 'document'").select(REC, F.col("first_slot").alias("zero"))
    n = g.nodes.where("otype = 'line'").join(zero, REC)
    return n.select(_item_id(), "label", long(F.col("first_slot") - F.col("zero") + 1).alias("first_word"), long(F.col("last_slot") - F.col("zero") + 1).alias("last_word"), "text")


@query(f"""WITH {_N_SQL} SELECT item_id, ordinal, CASE WHEN i % 3 = 1 THEN 'O' || CAST(i AS VARCHAR) WHEN i % {GROUP} = 0 THEN 'G' || CAST(i // {GROUP} AS VARCHAR) ELSE '' END AS surface,
  CASE WHEN i % {GROUP} = {GROUP - 1} OR ordinal = n THEN ' ' ELSE '' END AS separator FROM g""")
def diplomatic(spark, sf_dir):
    g = graph(spark, sf_dir)
    return surface(g.slots, g.nodes).join(g.slots.select("node_id", "ordinal"), "node_id").select(_item_id(), long("ordinal").alias("ordinal"), "surface", "separator")


@query(f"""WITH {_N_SQL}, p AS (SELECT item_id, 'orig' AS child, 'norm_group' AS parent, i // {GROUP} + 1 AS parent_ordinal, row_number() OVER (PARTITION BY item_id ORDER BY i) AS child_ordinal FROM g WHERE i % 3 = 1
  UNION ALL SELECT item_id, 'norm_group', 'orig_group', i // {GROUP} + 1, i // {GROUP} + 1 FROM g WHERE i % {GROUP} = 0)
SELECT item_id, child, CAST(child_ordinal AS BIGINT) AS child_ordinal, parent, CAST(parent_ordinal AS BIGINT) AS parent_ordinal FROM p""")
def graph_parents(spark, sf_dir):
    g = graph(spark, sf_dir)
    end = lambda k, name, *more: g.nodes.select(F.col("node_id").alias(k), F.col("otype").alias(name), long("source_ordinal").alias(f"{name}_ordinal"), *more)
    return Query(g).edges("parent").join(end("src", "child", REC), "src").join(end("dst", "parent"), "dst").select(_item_id(), "child", "child_ordinal", "parent", "parent_ordinal")


@query(f"WITH {_N_SQL} SELECT item_id, 'urn:cts:copticLit:ot.ruth.ed' || CAST(item_id // 3 AS VARCHAR) || ':' || CAST((item_id // 3) % 4 + 1 AS VARCHAR) AS scholarly_id, 'repo' AS repository, 'local' AS revision, CAST(count(*) AS BIGINT) AS n_words FROM g GROUP BY item_id")
def provenance(spark, sf_dir):
    q = Query(graph(spark, sf_dir), "repo", "local")
    return q.provenance(q.g.slots.select("node_id", REC)).groupBy(_item_id(), "scholarly_id", "repository", "revision").agg(F.count("*").alias("n_words"))


@query(f"""WITH {_N_SQL}, d AS (SELECT item_id, item_id // 3 AS family FROM n), first AS (SELECT min(item_id) AS item_id FROM d GROUP BY family),
best AS (SELECT coalesce(min(item_id) FILTER (item_id % 3 = 1), min(item_id)) AS item_id FROM d GROUP BY family)
SELECT 'all' AS view, item_id FROM d UNION ALL SELECT 'nonredundant', item_id FROM d UNION ALL SELECT 'source_preferred', item_id FROM first UNION ALL SELECT 'best_parsing', item_id FROM best""")
def views(spark, sf_dir):
    """Four views of one corpus. No two items make the same bytes, as each has a verse, book or family of its own; the rank prefers every third."""
    g = graph(spark, sf_dir)
    rank = g.documents.select(REC, F.when(long(REC) % 3 == 1, 1).otherwise(0).alias("rank"))
    distinct = g.documents.withColumn("content", F.concat("content", F.encode(REC, "utf-8")))
    return Query(type(g)(g.slots, g.nodes, g.edges, distinct, g.violations)).views(rank).select("view", _item_id())


# Parsing and audits

@query(f"""WITH {_N_SQL}, t AS (SELECT 'norm' AS name, item_id FROM g UNION ALL SELECT 'orig', item_id FROM g WHERE i % 3 = 1 UNION ALL SELECT 'entity', item_id FROM g WHERE i % 10 = 2 UNION ALL SELECT 'verse_n', item_id FROM g WHERE i % {VERSE} = 0
  UNION ALL SELECT 'lb_n', item_id FROM g WHERE i % {LINE} = 0 UNION ALL SELECT unnest(['orig_group', 'norm_group']), item_id FROM g WHERE i % {GROUP} = 0 UNION ALL SELECT unnest(['meta', 'translation']), item_id FROM n)
SELECT name, count(*) AS n_open, count(DISTINCT item_id) AS n_records, CASE name WHEN 'norm' THEN 'func,head,lemma,new_sent,norm,pos,xml:id' WHEN 'entity' THEN 'entity,head_tok' WHEN 'meta' THEN 'book,chapter,document_cts_urn' ELSE name END AS keys FROM t GROUP BY name""")
def tag_census(spark, sf_dir):
    return audits.tag_census(tag_events(records(spark, sf_dir))).select("name", "n_open", "n_records", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {_N_SQL} SELECT count(DISTINCT item_id) AS n_records, count(*) AS n_words, CAST(0 AS BIGINT) AS n_broken FROM g")
def checked_corpus(spark, sf_dir):
    """How much there is, and how often a rule of records or graphs is broken."""
    c = corpus(spark, sf_dir)
    broken = c.violations.select("rule").union(build_graph(c).violations.select("rule")).agg(F.count("*").alias("n_broken"))
    return c.words.agg(F.countDistinct(REC).alias("n_records"), F.count("*").alias("n_words")).crossJoin(broken)


_RUNS_SQL = f"""r AS (SELECT item_id, i // {VERSE} AS j, min(ordinal) AS "first", max(ordinal) AS "last", any_value(item_id // 3 % 4 + 1) AS chapter FROM g GROUP BY item_id, i // {VERSE}),
resolved AS (SELECT *, CASE WHEN item_id % 7 = 0 THEN 'unclassified_corpus' WHEN j % 4 = {UNNUMBERED} THEN 'unresolved' WHEN item_id % 5 = 0 THEN 'ambiguous' WHEN j % 2 = 1 OR j > 24 THEN 'unresolved' ELSE 'reference_candidate' END AS status,
  CASE WHEN item_id % 7 = 0 THEN 'corpus_not_reviewed' WHEN j % 4 = {UNNUMBERED} THEN 'no_number' WHEN item_id % 5 = 0 THEN 'book_contradicts' WHEN j % 2 = 1 OR j > 24 THEN 'address_absent' ELSE 'address_exists' END AS reason,
  'ed:Ruth:' || CAST(chapter AS VARCHAR) || ':' || CAST(j + 1 AS VARCHAR) AS address FROM r)"""


def verses(spark, sf_dir) -> DataFrame:
    """Another corpus with the odd verses of four chapters."""
    v = load(spark, sf_dir, "nation", "n_nationkey").select((F.col("n_nationkey") + 1).alias("verse")).where("verse % 2 = 1")
    v = v.select(F.lit("Ruth").alias("book"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("chapter"), "verse")
    return v.withColumn("node", long(1000 * F.col("chapter") + F.col("verse")))


def resolved(spark, sf_dir, c=None) -> DataFrame:
    return resolve_runs(c or corpus(spark, sf_dir), verses(spark, sf_dir), "ed")


@query(f"""WITH {_N_SQL}, {_RUNS_SQL} SELECT item_id, CAST(j + 1 AS BIGINT) AS run, "first", "last", status, reason, CASE WHEN status = 'reference_candidate' THEN address END AS shared_id FROM resolved""")
def resolver_cascade(spark, sf_dir):
    return resolved(spark, sf_dir).select(_item_id(), long("run").alias("run"), long("first").alias("first"), long("last").alias("last"), "status", "reason", "shared_id")


@query(f"""WITH {_N_SQL}, {_RUNS_SQL} SELECT status, reason, count(*) AS n_runs, CAST(sum("last" - "first" + 1) AS BIGINT) AS n_words FROM resolved GROUP BY ALL""")
def run_coverage(spark, sf_dir):
    c = corpus(spark, sf_dir)
    out = audits.coverage(resolved(spark, sf_dir, c), c.documents).where("dimension = 'status_and_reason'")
    return out.select(F.split("key_value", "/")[0].alias("status"), F.split("key_value", "/")[1].alias("reason"), "n_runs", "n_words")


@query(f"WITH {_N_SQL} SELECT count(*) AS n_words, CAST(0 AS BIGINT) AS n_uncovered FROM g")
def partition_proof(spark, sf_dir):
    """How many words lie in no run or in several, of how many."""
    c = corpus(spark, sf_dir)
    bad = audits.uncovered_words(resolved(spark, sf_dir, c), c.words)
    return c.words.agg(F.count("*").alias("n_words")).crossJoin(bad.agg(F.count("*").alias("n_uncovered")))


@query(f"""WITH {_N_SQL}, {_RUNS_SQL} SELECT item_id, 'reference_candidate' AS status, CAST(j + 1 AS VARCHAR) AS verse_n, "first", "last" FROM resolved WHERE status = 'reference_candidate' AND address = 'ed:Ruth:2:1'""")
def inverse_lookup(spark, sf_dir):
    """From an address back to the runs of words that carry it."""
    c = corpus(spark, sf_dir)
    found = witnesses(word_overlay(resolved(spark, sf_dir, c), build_graph(c).slots), "ed:Ruth:2:1")
    return found.select(_item_id(), "status", "verse_n", long("first").alias("first"), long("last").alias("last"))


@query(f"""WITH {_N_SQL}, {_RUNS_SQL} SELECT CAST(1000 * chapter + j + 1 AS BIGINT) AS node, address AS ref_id, count(*) AS n_spans FROM resolved WHERE status = 'reference_candidate' GROUP BY ALL""")
def address_overlay(spark, sf_dir):
    return verse_overlay(resolved(spark, sf_dir))


# Relations

def _related(spark, sf_dir) -> DataFrame:
    """Of each item four records of one identity: a text, the same bytes, another analysis, another text that quotes the next item; for the first 16 two records of declared books."""
    body = lambda first, lemma: F.concat(F.lit('<norm_group norm_group="g"><norm new_sent="true" norm="'), first, F.lit(f'" lemma="{lemma}">a</norm></norm_group>'))
    urn = F.concat(F.lit('<meta document_cts_urn="urn:cts:x:'), _text(F.col("item_id")), F.lit('"'))
    plain, nothing = F.concat(urn, F.lit(">"), body(F.lower(F.get("w", F.lit(0))), "a")), F.lit(None).cast("string")
    analysed = F.concat(urn, F.lit(">"), body(F.lower(F.get("w", F.lit(0))), "b"))
    quoting = F.concat(urn, F.lit(' witness="see urn:cts:x:'), _text(F.col("item_id") + 1), F.lit(', and others">'), body(F.lit("other"), "a"))
    of = lambda v: F.concat(F.lit("c/d:"), _id(F.col("item_id")), F.lit(f"-{v}"))
    number = F.lpad(_text(F.col("item_id")), 2, "0")
    declared = lambda prefix: F.when(F.col("item_id").between(1, 16), F.concat(F.lit(prefix), number)).otherwise(nothing)
    book = F.concat(F.lit("<meta>"), body(F.lower(F.get("w", F.lit(0))), "a"))
    pairs = [(of(0), plain), (of(1), plain), (of(2), analysed), (of(3), quoting), (declared("sahidica.mark/sahidica.mark:Mark_"), book), (declared("sahidica.nt/sahidica.nt:41_Mark_"), book)]
    each = F.explode(F.array(*(F.struct(k.alias(REC), t.alias("t")) for k, t in pairs)))
    return derive_relations(parse_records(_items(spark, sf_dir).select("item_id", each.alias("x")).select(f"x.{REC}", F.encode("x.t", "utf-8").alias("content")).where(F.col(REC).isNotNull())))


def _variant(c: str) -> F.Column:
    return F.substring(c, -1, 1).cast("bigint")


def _item(c: str) -> F.Column:
    return F.regexp_extract(c, r"([0-9]+)(-[0-9])?$", 1).cast("bigint")


@query(f"""WITH {_N_SQL} SELECT item_id, CAST(a AS BIGINT) AS "left", CAST(b AS BIGINT) AS "right", CASE WHEN b = 3 THEN 'textual_divergence' WHEN b = 2 THEN 'alternate_analysis' ELSE 'byte_identical' END AS classification
  FROM n, (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b) WHERE a < b""")
def identity_pairs(spark, sf_dir):
    r = _related(spark, sf_dir).where("kind = 'same_scholarly'")
    return r.select(_item(REC).alias("item_id"), _variant(REC).alias("left"), _variant("target_record_id").alias("right"), "classification")


@query(f"WITH {_N_SQL} SELECT item_id, 'byte_identical' AS classification, 'book_aggregate' AS family FROM n WHERE item_id BETWEEN 1 AND 16")
def declared_overlap(spark, sf_dir):
    return _related(spark, sf_dir).where("kind = 'documented_overlap'").select(_item(REC).alias("item_id"), "classification", "family")


@query(f"WITH {_N_SQL} SELECT n.item_id, 'urn:cts:x:' || CAST(m.item_id AS VARCHAR) AS target_id, CAST(v AS BIGINT) AS target FROM n JOIN n m ON m.item_id = n.item_id + 1, (SELECT unnest(range(0, 4)) AS v)")
def witness_links(spark, sf_dir):
    return _related(spark, sf_dir).where("kind = 'witness'").select(_item(REC).alias("item_id"), "target_id", _variant("target_record_id").alias("target"))


# Side files

def _side(spark, sf_dir) -> DataFrame:
    """CoNLL-U of the items by the remainder modulo 7: absent, blank, in a line too short, with an empty node, one word short, and twice right."""
    line = lambda k, form, head: F.concat_ws("\t", k, form, F.lit("_"), F.lit("X"), F.lit("_"), F.concat(F.lit("Place="), k), head, F.lit("dep"), F.lit("_"), F.lit("_"))
    # A sentence begins after a word with a full stop; ids and heads start anew there.
    starts = F.transform("w", lambda x, i: (i == 0) | F.coalesce(F.get("w", i - 1).endswith("."), F.lit(False)))
    begin = F.transform("w", lambda x, i: F.array_max(F.filter(F.sequence(F.lit(0), i), lambda k: F.get("starts", k))))
    rows = F.transform("w", lambda x, i: F.concat(F.when(F.get("starts", i) & (i > 0), "\n").otherwise(""), line(_text(i - F.get("begin", i) + 1), F.lower(x), _text(i - F.get("begin", i)))))
    kind = F.col("item_id") % 7
    whole = F.concat(F.array_join("rows", "\n"), F.lit("\n"))
    short = F.concat(F.array_join(F.slice("rows", F.lit(1), F.size("rows") - 1), "\n"), F.lit("\n"))
    content = F.when(kind == 1, F.lit(" \n")).when(kind == 2, F.lit("1\tshort\n")).when(kind == 3, F.concat(whole, F.lit("\n0.1"), F.lit("\t_" * 9), F.lit("\n"))).when(kind == 4, short).otherwise(whole)
    items = _items(spark, sf_dir).withColumn("starts", starts).withColumn("begin", begin).withColumn("rows", rows).where(kind != 0)
    return items.select(_id(F.col("item_id")).alias(REC), F.encode(content, "utf-8").alias("content"))


_SIDE_STATUS = "CASE item_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'malformed_conllu' WHEN 3 THEN 'unsupported_conllu_shape' WHEN 4 THEN 'token_alignment' ELSE 'supplemented' END"


@query(f"WITH {_N_SQL} SELECT item_id, {_SIDE_STATUS} AS status FROM n")
def supplement_status(spark, sf_dir):
    return supplement(corpus(spark, sf_dir), _side(spark, sf_dir))[1].select(_item_id(), "status")


@query(f"""WITH {_N_SQL}, b AS (SELECT *, min(ordinal) OVER (PARTITION BY item_id, sentence) AS began FROM g)
SELECT item_id, ordinal, CASE WHEN ordinal = began THEN 0 ELSE ordinal - 1 END AS ud_head, CAST(ordinal - began + 1 AS VARCHAR) AS place FROM b WHERE item_id % 7 IN (5, 6)""")
def supplement_words(spark, sf_dir):
    """Words with their heads, by ordinals of the record, from files that number them by sentence."""
    words, _ = supplement(corpus(spark, sf_dir), _side(spark, sf_dir))
    return words.where("ud_form IS NOT NULL").select(_item_id(), long("ordinal").alias("ordinal"), long("ud_head").alias("ud_head"), F.element_at("ud_feats", "Place").alias("place"))
