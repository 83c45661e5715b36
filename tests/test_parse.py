"""Parsing of small annotated records."""

import pytest

from lectern.plans.parse import REC, IntegrityError, parse_records

F1 = '''<meta corpus="demo" document_cts_urn=" urn:cts:demo:one " title="a" title="b">
<orig_group orig_group="AB"><norm_group norm_group="ab">
<orig orig="A"><norm xml:id="u1" new_sent="true" func="root" pos="N" lemma="a" norm="a">A</norm></orig>
<orig orig="B"><norm xml:id="u2" func="dep" head="#u1" pos="N" lemma="b" norm="b">B&amp;</norm></orig>
</norm_group></orig_group>
'''


def records(spark, *texts):
    return spark.createDataFrame([(f"c/d:{i}", bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)], f"{REC} string, content binary")


def wrap(inner, more=""):
    return f'<meta><norm_group norm_group="g">{inner}</norm_group>{more}'


W1 = '<norm xml:id="u1" new_sent="true" norm="abc">'


def test_minimal_record(spark):
    c = parse_records(records(spark, F1)).strict()
    words = c.words.orderBy("ordinal").collect()
    assert [(w["source_text"], w["head_ordinal"], w["orig_index"], w["sentence"]) for w in words] == [("A", 0, 0, 1), ("B&", 1, 1, 1)]
    assert [tuple(s)[1:] for s in c.sentences.collect()] == [(1, 1, 2)]
    d = c.documents.collect()[0]
    assert d["scholarly_id"] == "urn:cts:demo:one" and d["metadata"]["title"] == "a" and d["metadata_duplicates"]["title"] == ["a", "b"]
    assert [(g["index"], g["parent_index"]) for g in c.origs.orderBy("index").collect()] == [(0, 0), (1, 0)]


def test_layout_and_verses_inside_words(spark):
    text = wrap('<verse_n verse_n="1"><vid_n vid_n="x:1">' + W1 + 'ab<lb_n lb_n="2">c</norm><norm norm="d"><verse_n verse_n="2">d</norm><norm norm="e">e<verse_n verse_n="3">f</norm></verse_n><pb_xml_id pb_xml_id="p"><norm norm="g">g</norm>')
    c = parse_records(records(spark, text)).strict()
    assert [(w["verse_n"], w["vid_n"]) for w in c.words.orderBy("ordinal").collect()] == [("1", "x:1"), ("2", None), (None, None), (None, None)]
    events = [tuple(r)[1:7] for r in c.layout.orderBy("ordinal").collect()]
    assert events == [(1, "line", "2", 1, 2, 0), (2, "verse_n_marker", "3", 3, 1, 2), (3, "page", "p", None, None, 3)]


def test_crossing_wrappers_and_partial_words(spark):
    text = wrap(W1 + 'a<note note="n">bc</norm><hi_rend hi_rend="h"><norm norm="d">d</norm></note><norm norm="e">e</norm></hi_rend><gap reason="lost"></gap>')
    c = parse_records(records(spark, text)).strict()
    got = {a["kind"]: a for a in c.annotations.collect()}
    assert (got["note"]["start_word"], got["note"]["start_char"], got["note"]["first_full"], got["note"]["last_full"], got["note"]["ordinal"]) == (1, 1, 2, 2, 1)
    assert (got["hi_rend"]["first_full"], got["hi_rend"]["last_full"], got["hi_rend"]["ordinal"]) == (2, 3, 2)
    assert got["gap"]["source_attributes"] == {"reason": "lost"} and got["gap"]["value"] == ""


def test_entities_and_translations(spark):
    text = wrap('<translation translation="T1"><entity entity="person" head_tok="#u1">' + W1 + '<entity entity="place" head_tok="#u1">a</norm></entity></entity><norm norm="b">b</norm></translation><arabic arabic="ar"><norm norm="c">c</norm></arabic>')
    c = parse_records(records(spark, text)).strict()
    assert [(e["ordinal"], e["parent_ordinal"], e["first"], e["last"], e["head_ordinal"]) for e in c.entities.orderBy("ordinal").collect()] == [(1, None, 1, 1, 1), (2, 1, 1, 1, 1)]
    assert sorted((t["otype"], t["text"], t["first"], t["last"], t["source_tag"]) for t in c.translations.collect()) == [("arabic_translation", "ar", 3, 3, "arabic"), ("translation", "T1", 1, 2, None)]


BROKEN = {
    "invalid_utf8": b"<meta>\xff", "empty_record": " \n", "no_leading_metadata": "x<meta>", "malformed_attributes": "<meta><foo a=b>", "repeated_attribute": '<meta><foo a="1" a="2">',
    "group_order": "<meta><norm>a</norm>", "unclosed_group": '<meta><norm_group norm_group="g">', "closing_without_opening": "<meta></note>", "unclosed_wrapper": '<meta><note note="n">',
    "token_wrapper_outside_word": '<meta><morph morph="m"></morph>', "unknown_attribute": '<meta><gap colour="x"></gap>', "no_value": "<meta><note></note>", "attribute_mismatch": '<meta><hi hi="x"></hi>',
    "duplicate_word_id": wrap(W1 + "a</norm>" + W1 + "b</norm>"), "unresolved_head": wrap('<norm new_sent="true" head="#zz">a</norm>'), "no_sentence_start": wrap('<norm norm="a">a</norm>'),
    "entity_head_missing": wrap('<entity entity="p">' + W1 + "a</norm></entity>"), "entity_head_unresolved": wrap('<entity head_tok="#q">' + W1 + "a</norm></entity>"),
    "entity_head_outside": wrap(W1 + 'a</norm><entity head_tok="#u1"><norm norm="b">b</norm></entity>'), "no_word_locus": wrap(W1 + "a</norm>", '<translation translation="t"></translation>'),
    "token_wrapper_crosses_word": wrap(W1 + 'a<morph morph="m">b</norm><norm norm="c"></morph>c</norm>'),
}


def test_every_rule_is_reported(spark):
    c = parse_records(records(spark, *BROKEN.values()))
    found = {}
    for v in c.violations.collect():
        found.setdefault(v[REC], set()).add(v["rule"])
    for i, name in enumerate(BROKEN):
        assert name in found.get(f"c/d:{i}", set()), name
    with pytest.raises(IntegrityError):
        c.strict()


def test_partitioning_changes_nothing(spark):
    r = records(spark, F1, *[wrap(W1 + f"a{i}</norm>") for i in range(6)])
    one = sorted(map(str, parse_records(r.repartition(1)).words.collect()))
    assert one == sorted(map(str, parse_records(r.repartition(7)).words.collect()))
