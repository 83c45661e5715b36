"""Graph, relations, CoNLL-U and queries on small records."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.corpus import MissingFeature, Query
from lectern.operators.relations import derive_relations, unresolved_witnesses
from lectern.plans.graph import build_graph, digest, surface
from lectern.plans.parse import REC, parse_records
from lectern.sources.conllu import read_record, supplement
from lectern.sources.features import read_feature, write_features
from lectern.sources.records import layout_violations, read_records, record_violations
from tests.test_parse import F1, W1, records, wrap

LAYOUT = wrap('<lb_n lb_n="1">' + W1 + 'ab<lb_n lb_n="2">c</norm><entity entity="person" head_tok="#u2"><norm xml:id="u2" norm="d" func="x" head="#u1">de</norm></entity><lb_n lb_n="3"><note note="n"></note>')


@pytest.fixture(scope="module")
def graph(spark):
    c = parse_records(records(spark, LAYOUT, F1)).strict()
    g = build_graph(c, derive_relations(c)).strict()
    return c, g


def test_ids_are_dense_and_ordered(spark, graph):
    _, g = graph
    assert [r["node_id"] for r in g.slots.orderBy(REC, "ordinal").collect()] == [1, 2, 3, 4]
    nodes = g.nodes.orderBy("node_id").collect()
    assert [n["node_id"] for n in nodes] == list(range(5, 5 + len(nodes)))
    assert [(n["otype"], n["first_slot"], n["last_slot"]) for n in nodes[:4]] == [("document", 1, 2), ("document", 3, 4), ("sentence", 1, 2), ("sentence", 3, 4)]
    lines = [(n["label"], n["first_slot"], n["last_slot"], n["text"]) for n in nodes if n["otype"] == "line"]
    assert lines == [("1", 1, 1, "ab"), ("2", 1, 2, "cde"), ("3", 2, 2, "")]
    note = next(n for n in nodes if n["otype"] == "note")
    assert (note["render_mode"], note["first_slot"]) == ("editorial_anchor", 2)


def test_edges(spark, graph):
    _, g = graph
    kinds = {r["kind"]: r["count"] for r in g.edges.groupBy("kind").count().collect()}
    assert kinds == {"dependency_head": 2, "entity_head": 1, "parent": 3, "direct_word": 2}
    q = Query(g, "repo", "rev")
    assert [tuple(r) for r in q.dependency_pairs().orderBy("src").collect()] == [(2, 1), (4, 3)]
    assert q.entity_heads("person").collect()[0]["head_word"] == 2
    assert q.words(lemma="b").collect()[0][REC] == "c/d:1"
    assert q.provenance(q.words(lemma="b")).collect()[0]["revision"] == "rev"
    assert {r["text"] for r in q.text().collect()} == {"abc de", "A B&"}
    assert sorted((r["node_id"], r["word"]) for r in q.held(q.nodes("sentence")).collect()) == [(7, 1), (7, 2), (8, 3), (8, 4)]
    with pytest.raises(MissingFeature):
        q.words(colour="red")
    with pytest.raises(ValueError):
        q.with_overlay(g.slots.select("node_id"), "of another graph")
    assert q.with_overlay(g.slots.select("node_id", F.lit(1).alias("own")), digest(g).collect()[0][0]).where("own = 1").count() == g.slots.count()
    assert g.census().where("what = 'node' AND key = 'line'").collect()[0]["n"] == 3


def test_order_of_records_changes_nothing(spark):
    texts = [F1, LAYOUT]
    a = records(spark, *texts)
    b = a.orderBy(F.desc(REC)).repartition(5)
    assert digest(build_graph(parse_records(a))).collect() == digest(build_graph(parse_records(b))).collect()


def test_surface_override(spark, graph):
    _, g = graph
    got = {r["node_id"]: (r["surface"], r["separator"]) for r in surface(g.slots, g.nodes).collect()}
    assert got == {1: ("abc", " "), 2: ("de", " "), 3: ("A", ""), 4: ("B", " ")}


def test_relations(spark):
    m = '<meta document_cts_urn="urn:cts:x:1" witness="{w}"><norm_group norm_group="g">' + '<norm new_sent="true" norm="{n}" lemma="{l}">a</norm></norm_group>'
    texts = [m.format(w="", n="a", l="1"), m.format(w="", n="a", l="2"), m.format(w="", n="b", l="1"), m.format(w="", n="a", l="1"), '<meta witness="see urn:cts:x:1, and (urn:cts:none:2).">']
    c = parse_records(records(spark, *texts))
    r = derive_relations(c).collect()
    same = {(x[REC][-1], x["target_record_id"][-1]): x["classification"] for x in r if x["kind"] == "same_scholarly"}
    assert same == {("0", "1"): "alternate_analysis", ("0", "2"): "textual_divergence", ("0", "3"): "byte_identical", ("1", "2"): "textual_divergence", ("1", "3"): "alternate_analysis", ("2", "3"): "textual_divergence"}
    assert sum(x["kind"] == "witness" for x in r) == 4
    assert [x["target_id"] for x in unresolved_witnesses(c).collect()] == ["urn:cts:none:2"]


def line(n, form, head="0", deps="_", feats="_"):
    return "\t".join([n, form, "_", "VERB", "_", feats, head, "root", deps, "_"])


def test_supplements(spark):
    good = "# c\n" + line("1", "a", "0", feats="Number=Sing|Case=Nom") + "\n" + line("2", "b", "1") + "\n"
    side = {"c/d:1": good, "C/D:2": "", "c/d:3": line("2", "a"), "c/d:4": good.replace("0\troot\t_", "0\troot\t1:x", 1), "c/d:5": good.replace("\tb\t", "\tz\t"), "c/d:6": b"\xff", "c/d:9": good}
    c = parse_records(records(spark, *[F1] * 7))
    s = spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else v.encode())) for k, v in side.items()], f"{REC} string, content binary")
    words, ledger = supplement(c, s)
    assert sorted((r[REC] or "", r["status"]) for r in ledger.collect()) == [
        ("", "without_counterpart"), ("c/d:0", "missing"), ("c/d:1", "supplemented"), ("c/d:2", "placeholder"), ("c/d:3", "malformed_conllu"), ("c/d:4", "unsupported_conllu_shape"), ("c/d:5", "token_alignment"), ("c/d:6", "invalid_utf8")]
    got = [(r["ordinal"], r["ud_head"], r["ud_feats"]) for r in words.where(F.col(REC) == "c/d:1").orderBy("ordinal").collect()]
    assert got == [(1, 0, {"Number": "Sing", "Case": "Nom"}), (2, 1, {})]
    assert words.where(F.col("ud_form").isNotNull()).count() == 2


def test_discovery(spark, tmp_path):
    import zipfile

    (tmp_path / "corp" / "set_TT").mkdir(parents=True)
    (tmp_path / "corp" / "set_TT" / "one.tt").write_text(F1)
    with zipfile.ZipFile(tmp_path / "corp" / "pack_TT.zip", "w") as z:
        z.writestr("pack_TT/two.tt", F1)
        z.writestr("three.tt", F1)
        z.writestr("deep/er/no.tt", F1)
    r = read_records(spark, str(tmp_path))
    assert sorted(x["source_record_id"] for x in r.collect()) == ["corp/pack:three", "corp/pack:two", "corp/set:one"]
    assert record_violations(r).count() == 0
    assert parse_records(r).strict().words.count() == 6
    assert [tuple(x) for x in layout_violations(spark, str(tmp_path)).collect()] == [("nested_member", "corp/pack_TT.zip!/deep/er/no.tt")]
    (tmp_path / "corp" / "set_TT" / "sub").mkdir()
    (tmp_path / "corp" / "set_TT" / "sub" / "x.tt").write_text(F1)
    (tmp_path / "corp" / "set_TT" / "x.txt").write_text(F1)
    (tmp_path / "corp" / "bad_TT.zip").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "corp" / "none_TT.zip", "w") as z:
        z.writestr("a.txt", "")
    got = {tuple(x) for x in layout_violations(spark, str(tmp_path)).collect()}
    assert got == {("nested_member", "corp/pack_TT.zip!/deep/er/no.tt"), ("nested_record", "corp/set_TT/sub/x.tt"), ("unsupported_file", "corp/set_TT/x.txt"), ("broken_archive", "corp/bad_TT.zip"),
                   ("unsupported_member", "corp/none_TT.zip!/a.txt"), ("empty_dataset", "corp/none_TT.zip")}


def test_the_first_sentence_at_fault_decides():
    shape, wrong = line("1", "a", deps="1:x"), line("2", "a")
    assert read_record(f"{shape}\n\n{wrong}\n".encode())[1] == "unsupported_conllu_shape"
    assert read_record(f"{wrong}\n\n{shape}\n".encode())[1] == "malformed_conllu"


def test_features_are_projected_and_read_back(spark, graph, tmp_path):
    _, g = graph
    path = f"{tmp_path}/features"
    names = write_features(g, path, {"made": "by a test"})
    assert {"otype", "oslots", "norm", "source_text", "dependency_head", "parent", "direct_word"} <= set(names)
    values = {r["node_id"]: r["value"] for r in read_feature(spark, f"{path}/norm").collect()}
    assert values == {r["node_id"]: r["norm"] for r in g.slots.collect() if r["norm"] is not None}
    kinds = {r["node_id"]: r["value"] for r in read_feature(spark, f"{path}/otype").collect()}
    assert kinds == {r["node_id"]: "word" for r in g.slots.collect()} | {r["node_id"]: r["otype"] for r in g.nodes.collect()}
    heads = {(r["src"], r["dst"]) for r in read_feature(spark, f"{path}/dependency_head").collect()}
    assert heads == {(r["src"], r["dst"]) for r in g.edges.where("kind = 'dependency_head'").collect()}
    assert any(n.startswith("meta_") for n in names)
    with pytest.raises(FileExistsError):
        write_features(g, path)
    assert [p.name for p in tmp_path.iterdir()] == ["features"]


def test_offsets_of_more_groups_than_a_range_sample_holds(spark):
    from lectern.operators.ids import dense_ids

    groups = spark.range(0, 600_000, 1, 16).select(F.xxhash64("id").alias("key"), F.col("id").alias("unused"), F.lit("x").alias("more"))
    rows = groups.select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    got = dense_ids(rows, groups, "key", [F.col("key")], "ordinal").select("key", "ordinal", "node_id")
    r = got.agg(F.count("*"), F.countDistinct("node_id"), F.min("node_id"), F.max("node_id")).collect()[0]
    assert tuple(r) == (1_200_000, 1_200_000, 1, 1_200_000)
