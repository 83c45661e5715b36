"""From tag events to the tables of a corpus, by window algebra.

Every rule a record must keep becomes rows of ``violations``; :meth:`Corpus.strict`
raises on the first of them, and a ledger reader just looks at the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import INTERVENTION_KEYS, LAYOUT, TRACK, VERSE, WRAPPERS, value_key
from ..sources.markup import tag_events
from ..tables import written

REC = "source_record_id"
GROUPS = ("orig_group", "norm_group", "orig", "norm")


class IntegrityError(ValueError):
    """A record breaks a rule."""


@dataclass
class Corpus:
    documents: DataFrame
    words: DataFrame
    sentences: DataFrame
    orig_groups: DataFrame
    norm_groups: DataFrame
    origs: DataFrame
    layout: DataFrame
    entities: DataFrame
    translations: DataFrame
    annotations: DataFrame
    violations: DataFrame

    def strict(self) -> Corpus:
        bad = self.violations.orderBy(REC, "seq", "rule").take(1)
        if bad:
            raise IntegrityError(f"{bad[0]['rule']} in {bad[0][REC]}: {bad[0]['detail']}")
        return self


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def positioned(events: DataFrame) -> DataFrame:
    """Events with where they stand: in a word or between words, at which character, and in which verse."""
    w = Window.partitionBy(REC).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(REC).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opening, closing = ~F.col("closing"), F.col("closing")
    cols = {}
    for g in GROUPS:
        cols[f"opened_{g}"] = F.coalesce(_count(opening & (F.col("name") == g)).over(before), F.lit(0))
        cols[f"closed_{g}"] = F.coalesce(_count(closing & (F.col("name") == g)).over(before), F.lit(0))
    e = events.withColumns(cols)
    inside = F.col("opened_norm") > F.col("closed_norm")
    e = e.withColumns({"in_word": inside, "word": F.when(inside, F.col("opened_norm")).when(opening & (F.col("name") == "norm"), F.col("opened_norm") + 1)})
    # The text before a tag counts for the word that is open there.
    in_word = Window.partitionBy(REC, "opened_norm").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("offset", F.sum(F.when(F.col("in_word"), F.length("piece")).otherwise(0)).over(in_word))
    e = e.withColumn("midword", F.col("in_word") & (F.col("offset") > 0) & opening & F.col("name").isin(*VERSE))
    # Verse literals carry on until the next marker, or are blanked by an outer one.
    state = {}
    for i, v in enumerate(VERSE):
        sets = F.when(opening & (F.col("name") == v), F.struct(F.element_at("attrs", v).alias("x")))
        blanks = (closing & F.col("name").isin(v, "verse_n")) | (opening & (F.col("name") == "verse_n") & F.lit(i > 0))
        state[v] = F.last(F.coalesce(sets, F.when(blanks, F.struct(F.lit(None).cast("string").alias("x")))), ignorenulls=True).over(before)["x"]
        state[f"set_{v}"] = F.when(F.col("in_word") & ~F.col("midword"), F.coalesce(sets, F.when(opening & (F.col("name") == "verse_n") & F.lit(i > 0), F.struct(F.lit(None).cast("string").alias("x")))))
    return e.withColumns(state).withColumn("completed", F.col("closed_norm"))


def _words(e: DataFrame) -> DataFrame:
    is_open = ~F.col("closing") & (F.col("name") == "norm")
    inside = e.where("word IS NOT NULL")
    own = F.max(F.when(is_open, F.struct("seq", F.to_json("attrs").alias("a"), *VERSE, "opened_norm_group", "opened_orig", "closed_orig"))).alias("own")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_word"), F.struct("seq", "piece")))), lambda x: x["piece"]), "").alias("source_text")
    later = [F.max_by(f"set_{v}", F.when(F.col(f"set_{v}").isNotNull(), F.col("seq"))).alias(f"last_{v}") for v in VERSE]
    g = inside.groupBy(REC, F.col("word").cast("int").alias("ordinal")).agg(own, text, F.max("midword").alias("crossed"), *later)
    a = F.from_json("own.a", "map<string,string>")
    g = g.withColumn("attrs", a)
    get = lambda k: F.element_at("attrs", k)
    verses = [F.when(~F.col("crossed"), F.when(F.col(f"last_{v}").isNotNull(), F.col(f"last_{v}.x")).otherwise(F.col(f"own.{v}"))).alias(v) for v in VERSE]
    return g.select(
        REC, "ordinal", get("xml:id").alias("source_id"), get("norm").alias("norm"), get("lemma").alias("lemma"), get("pos").alias("pos"), get("func").alias("func"), get("head").alias("head_literal"),
        get("lang").alias("original_lang"), (F.lower(get("new_sent")) == "true").alias("starts"), "source_text", *verses, F.col("own.seq").alias("seq"),
        (F.col("own.opened_norm_group") - 1).alias("norm_group_index"), F.when(F.col("own.opened_orig") > F.col("own.closed_orig"), F.col("own.opened_orig") - 1).alias("orig_index"),
    )


def _with_heads(words: DataFrame) -> DataFrame:
    target = F.regexp_replace("head_literal", r"\A#", "")
    ids = words.where("source_id IS NOT NULL AND source_id != ''").groupBy(F.col(REC).alias("__r"), F.col("source_id").alias("__id")).agg(F.min("ordinal").alias("__head"))
    given = F.coalesce(F.col("head_literal"), F.lit("")) != ""
    out = words.join(ids, (F.col(REC) == F.col("__r")) & given & (target == F.col("__id")), "left")
    return out.withColumn("head_ordinal", F.when(given, F.col("__head")).when(F.col("func") == "root", 0)).drop("__r", "__id", "__head")


def matched(e: DataFrame) -> DataFrame:
    """Openings of span tags with where they end, matched per kind: kinds may cross one another.

    At equal depth of one kind openings and closings alternate, so an opening's
    closing is the next event at its depth.
    """
    kinds = [*TRACK, "entity", "translation", "arabic", "arabic_translation"]
    s = e.where(F.col("name").isin(*kinds)).withColumn("stack", F.when(F.col("name").startswith("arabic"), "arabic").otherwise(F.col("name")))
    run = Window.partitionBy(REC, "stack").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(run)
    s = s.withColumn("depth", level + F.when(F.col("closing"), 1).otherwise(0))
    follow = Window.partitionBy(REC, "stack", "depth").orderBy("seq")
    here = F.struct("seq", "closing", F.when(F.col("in_word"), F.col("word")).cast("int").alias("word"), F.when(F.col("in_word"), F.col("offset")).cast("int").alias("char"), F.col("completed").cast("int").alias("after"), F.col("opened_norm").cast("int").alias("opened"))
    return s.withColumns({"here": here, "end": F.lead(here).over(follow)})


def _spans(m: DataFrame) -> DataFrame:
    o = m.where(~F.col("closing"))
    return o.where(F.col("end.closing"))


def _annotations(spans: DataFrame) -> DataFrame:
    track = F.element_at(F.create_map(*(F.lit(x) for kv in TRACK.items() for x in kv)), F.col("name"))
    key = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in TRACK if value_key(k) != k for x in (k, value_key(k)))), F.col("name")), F.col("name"))
    a = spans.where(F.col("name").isin(*TRACK)).withColumn("track", track)
    full = F.col("here.after") + F.when((F.col("here.word").isNotNull()) & (F.coalesce(F.col("here.char"), F.lit(0)) > 0), 2).otherwise(1)
    value = F.when(F.col("track") == "intervention", F.coalesce(F.element_at("attrs", key), F.lit(""))).otherwise(F.element_at("attrs", key))
    own = F.when((F.col("track") == "intervention") | ((F.col("name") == "morph") & F.map_contains_key("attrs", "lang")), F.col("attrs"))
    return a.select(
        REC, "track", F.col("name").alias("kind"), F.row_number().over(Window.partitionBy(REC, "track").orderBy("seq")).alias("ordinal"), value.alias("value"), own.alias("source_attributes"),
        F.col("verse_n").alias("source_verse_n"), F.col("here.word").alias("start_word"), F.col("here.char").alias("start_char"), F.col("here.after").alias("start_after"),
        F.col("end.word").alias("end_word"), F.col("end.char").alias("end_char"), F.col("end.after").alias("end_after"), full.alias("first_full"), F.col("end.after").alias("last_full"), "seq",
    )


def _locus(spans: DataFrame) -> DataFrame:
    """Words from the one a span opens in, or the next, to the last one opened before it ends."""
    return spans.withColumns({"first": F.when(F.col("here.word").isNotNull(), F.col("here.word")).otherwise(F.col("here.opened") + 1), "last": F.col("end.opened")})


def _entities(spans: DataFrame, words: DataFrame) -> DataFrame:
    e = _locus(spans.where("name = 'entity'")).withColumn("ordinal", F.row_number().over(Window.partitionBy(REC).orderBy("seq")))
    outer = e.select(F.col(REC).alias("__r"), (F.col("depth") + 1).alias("__d"), F.col("seq").alias("__from"), F.col("end.seq").alias("__to"), F.col("ordinal").alias("parent_ordinal"))
    e = e.join(outer, (F.col(REC) == F.col("__r")) & (F.col("depth") == F.col("__d")) & (F.col("seq") > F.col("__from")) & (F.col("seq") < F.col("__to")), "left")
    ids = words.where("source_id IS NOT NULL").groupBy(F.col(REC).alias("__w"), F.col("source_id").alias("__id")).agg(F.min("ordinal").alias("head_ordinal"))
    e = e.join(ids, (F.col(REC) == F.col("__w")) & (F.regexp_replace(F.element_at("attrs", "head_tok"), r"\A#", "") == F.col("__id")), "left")
    get = lambda k: F.element_at("attrs", k)
    return e.select(REC, "ordinal", "parent_ordinal", get("entity").alias("entity_class"), get("identity").alias("identity"), get("head_tok").alias("head_literal"), "head_ordinal", get("text").alias("source_text_literal"), "first", "last", "seq")


def _translations(spans: DataFrame) -> DataFrame:
    t = _locus(spans.where(F.col("stack").isin("translation", "arabic")))
    by_end = Window.partitionBy(REC, "stack").orderBy("end.seq")
    text = F.when(F.col("stack") == "translation", F.coalesce(F.element_at("attrs", "translation"), F.lit(""))).otherwise(
        F.coalesce(F.nullif(F.element_at("attrs", "arabic"), F.lit("")), F.element_at("attrs", "arabic_translation"), F.lit("")))
    return t.select(REC, F.when(F.col("stack") == "arabic", "arabic_translation").otherwise("translation").alias("otype"), F.row_number().over(by_end).alias("ordinal"), text.alias("text"), F.when(F.col("stack") == "arabic", F.col("name")).alias("source_tag"), "first", "last", "seq")


def _layout(e: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in LAYOUT.items() for x in kv)), F.col("name"))
    points = e.where(~F.col("closing") & (F.col("name").isin(*LAYOUT) | F.col("midword")))
    return points.select(
        REC, F.row_number().over(Window.partitionBy(REC).orderBy("seq")).alias("ordinal"), F.coalesce(kind, F.concat("name", F.lit("_marker"))).alias("kind"), F.element_at("attrs", F.col("name")).alias("value"),
        F.when(F.col("in_word"), F.col("word")).cast("int").alias("word_ordinal"), F.when(F.col("in_word"), F.col("offset")).cast("int").alias("char_offset"), F.col("completed").cast("int").alias("after_word_ordinal"), "seq",
    )


def _group(e: DataFrame, name: str, parent: str | None) -> DataFrame:
    g = e.where(~F.col("closing") & (F.col("name") == name))
    up = F.when(F.col(f"opened_{parent}") > F.col(f"closed_{parent}"), F.col(f"opened_{parent}") - 1) if parent else F.lit(None).cast("long")
    return g.select(REC, F.col(f"opened_{name}").cast("int").alias("index"), F.element_at("attrs", name).alias("value"), up.cast("int").alias("parent_index"), "seq")


def _violations(events: DataFrame, e: DataFrame, m: DataFrame, words: DataFrame, entities: DataFrame, translations: DataFrame) -> DataFrame:
    def rule(df: DataFrame, condition, name, detail="''") -> DataFrame:
        name = F.lit(name) if isinstance(name, str) else name
        return df.where(condition).select(name.alias("rule"), REC, F.col("seq").cast("int").alias("seq"), F.expr(detail).cast("string").alias("detail"))

    live = {g: F.col(f"opened_{g}") - F.col(f"closed_{g}") for g in GROUPS}
    none_open = lambda *gs: (sum((live[g] for g in gs), F.lit(0)) == 0)
    may_open = {"orig_group": none_open(*GROUPS), "norm_group": none_open("norm_group", "orig", "norm"), "orig": (live["norm_group"] == 1) & none_open("orig", "norm"), "norm": (live["norm_group"] == 1) & none_open("norm")}
    may_close = {g: (live[g] == 1) & none_open(*GROUPS[i + 1 :]) for i, g in enumerate(GROUPS)}
    opening, name, keys = ~F.col("closing"), F.col("name"), F.map_keys("attrs")
    wrong_order = [opening & (name == g) & ~ok for g, ok in may_open.items()] + [F.col("closing") & (name == g) & ~ok for g, ok in may_close.items()]
    out = [rule(events, F.col("problem").isNotNull(), F.col("problem"), "name")]
    out.append(rule(e, F.greatest(*(F.coalesce(c, F.lit(False)) for c in wrong_order)), "group_order", "name"))
    out.append(rule(e, name.isNull() & (F.col("seq") > 0) & ~none_open(*GROUPS), "unclosed_group"))
    token = name.isin(*WRAPPERS["token"])
    out.append(rule(e, token & ~F.col("in_word"), "token_wrapper_outside_word", "name"))
    out.append(rule(m, F.col("closing") & (F.col("depth") <= 0), "closing_without_opening", "name"))
    out.append(rule(m, opening & (F.col("end").isNull() | ~F.col("end.closing")), "unclosed_wrapper", "name"))
    crossing = opening & token & F.col("end.closing") & ((F.col("here.word") != F.col("end.word")) | F.col("end.word").isNull())
    out.append(rule(m, crossing, "token_wrapper_crosses_word", "name"))
    for kind, allowed in INTERVENTION_KEYS.items():
        out.append(rule(e, opening & (name == kind) & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0), "unknown_attribute", "name"))
        out.append(rule(e, opening & (name == kind) & (F.size(keys) == 0), "no_value", "name"))
    exact = [*WRAPPERS["residual"], *WRAPPERS["translation_source"]]
    for kind in [k for k in exact if value_key(k) != k]:
        out.append(rule(e, opening & (name == kind) & ((F.size(keys) != 1) | ~F.array_contains(keys, value_key(kind))), "attribute_mismatch", "name"))
    same = opening & name.isin(*(k for k in exact if value_key(k) == k))
    out.append(rule(e, same & ((F.size(keys) != 1) | ~F.array_contains(keys, name)), "attribute_mismatch", "name"))
    out.append(rule(e, opening & (name == "morph") & (F.size(F.array_except(keys, F.array(F.lit("morph"), F.lit("lang")))) > 0), "attribute_mismatch", "name"))
    plain = opening & name.isin(*(k for k, t in TRACK.items() if t not in ("intervention", "residual", "translation_source")), *VERSE)
    out.append(rule(e, plain & ~F.array_contains(keys, name), "no_value", "name"))
    again = words.where("source_id IS NOT NULL AND source_id != ''").withColumn("n", F.count("*").over(Window.partitionBy(REC, "source_id")))
    out.append(rule(again, F.col("n") > 1, "duplicate_word_id", "source_id"))
    out.append(rule(words, (F.coalesce(F.col("head_literal"), F.lit("")) != "") & F.col("head_ordinal").isNull(), "unresolved_head", "head_literal"))
    out.append(rule(words, (F.col("ordinal") == 1) & ~F.coalesce(F.col("starts"), F.lit(False)), "no_sentence_start"))
    out.append(rule(entities, F.coalesce(F.col("head_literal"), F.lit("")) == "", "entity_head_missing"))
    out.append(rule(entities, (F.coalesce(F.col("head_literal"), F.lit("")) != "") & F.col("head_ordinal").isNull(), "entity_head_unresolved", "head_literal"))
    out.append(rule(entities, F.col("head_ordinal").isNotNull() & ~F.col("head_ordinal").between(F.col("first"), F.col("last")), "entity_head_outside", "head_literal"))
    out.append(rule(translations, F.col("last") < F.col("first"), "no_word_locus", "otype"))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def parse_events(records: DataFrame, events: DataFrame) -> Corpus:
    # Every table below starts from these, which are computed once.
    e = written(positioned(events), "events")
    m = written(matched(e), "spans")
    words = _with_heads(written(_words(e), "bare-words"))
    spans = _spans(m)
    starts = Window.partitionBy(REC).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("sentence", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(starts).cast("int"))
    words = written(words, "words")
    entities, translations = written(_entities(spans, words), "entities"), _translations(spans)
    sentences = words.where("sentence > 0").groupBy(REC, F.col("sentence").alias("ordinal")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    meta = events.where("seq = 0 AND name = 'meta' AND NOT closing").select(REC, F.col("attrs").alias("metadata"), F.col("repeated").alias("metadata_duplicates"))
    documents = records.join(meta, REC, "left").withColumn("scholarly_id", F.nullif(F.trim(F.element_at("metadata", "document_cts_urn")), F.lit("")))
    return Corpus(
        documents, words, sentences, _group(e, "orig_group", None), _group(e, "norm_group", "orig_group"), _group(e, "orig", "norm_group"),
        _layout(e), entities, translations, _annotations(spans), _violations(events, e, m, words, entities, translations),
    )


def parse_records(records: DataFrame) -> Corpus:
    """records: source_record_id, content and any other columns, kept in documents."""
    return parse_events(records, tag_events(records))
