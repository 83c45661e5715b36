"""Probes around markers, and the converter."""

import pytest

from lectern import cli
from lectern.operators import probes
from lectern.plans.parse import REC, IntegrityError, parse_records
from lectern.sources.markup import tag_events
from lectern.tables import written
from tests.test_parse import F1
from tests.test_references import ruth, verse


def test_markers(spark):
    zero = ruth("", verse(0, "a", "b", first=True) + verse(1, "c") + verse(4, "d"))
    records = spark.createDataFrame([("z", bytearray(zero.encode())), ("n", bytearray(ruth("", verse(1, "a", first=True) + verse(0, "b")).encode()))], f"{REC} string, content binary")
    e = written(tag_events(records), "events")
    assert {r[REC]: (r["status"], r["n_words"]) for r in probes.verse_zero(e).collect()} == {"z": ("superscription", 2), "n": ("not_first", None)}
    wanted = spark.createDataFrame([("z", 3, 1, 4), ("z", 2, 5, 6), ("z", 9, 1, 2)], f"{REC} string, marker int, previous long, current long")
    assert [(r["marker"], r["status"], r["words_between"]) for r in probes.gap_context(e, wanted).orderBy("marker").collect()] == [(2, "markers_differ", 2), (3, "confirmed", 1), (9, "marker_missing", None)]


def test_pairs_and_tables(spark):
    body = '<verse_vid verse_vid="46N 14:1"><verse verse="1"><sbl_greek sbl_greek="x"><norm new_sent="true" norm="a">a</norm><norm norm="b">b</norm></sbl_greek></verse><sbl_apparatus sbl_apparatus="y"><norm norm="c">c</norm></sbl_apparatus></verse_vid>'
    c = parse_records(spark.createDataFrame([("p", bytearray(ruth("", body).encode()))], f"{REC} string, content binary")).strict()
    pairs = probes.paired_verses(c)
    assert sorted((r["ordinal"], r["number"]) for r in pairs.collect()) == [(1, 1), (2, 1)]
    spans = c.annotations.where("track = 'sbl'")
    assert {r["kind"]: (r["number"], r["label"]) for r in probes.pair_of_span(pairs, spans).collect()} == {"sbl_greek": (1, "46N 14:1"), "sbl_apparatus": (None, None)}
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    table = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "source string, target string")
    verses = spark.createDataFrame([("x",)], "target string")
    assert {r["source"]: r["status"] for r in probes.exception_table(rows, table, verses).collect()} == {"a": "target_exists", "b": "no_target", "c": "target_absent", "d": "no_rule"}
    gaps = spark.createDataFrame([("r", "Ps", 1, 2), ("r", "Ps", 1, 3)], f"{REC} string, book string, chapter int, missing long")
    known = spark.createDataFrame([("e1", "Ps", 1, 2)], "edition string, book string, chapter int, verse long")
    assert {r["missing"]: r["present_in"] for r in probes.edition_probe(gaps, ["e1", "e2"], known).collect()} == {2: ["e1"], 3: []}
    two = spark.createDataFrame([("s", ["Ά", "x"], ["β"]), ("t", ["β"], ["α"]), ("u", ["q"], ["q"])], f"{REC} string, first array<string>, second array<string>")
    assert {r[REC]: r["status"] for r in probes.motif_status(two, ["α"], ["β"]).collect()} == {"s": "same_numbering", "t": "shifted", "u": "inconclusive"}


def test_convert(spark, tmp_path):
    (tmp_path / "src" / "corp" / "set_TT").mkdir(parents=True)
    (tmp_path / "src" / "corp" / "set_TT" / "one.tt").write_text(F1)
    out = cli.convert(spark, f"{tmp_path}/src", f"{tmp_path}/out", summary=f"{tmp_path}/summary.json")
    assert out["tables"]["words"] == 2 and out["edges"]["dependency_head"] == 1 and out["without_license"] == 1
    assert (tmp_path / "summary.json").exists() and (tmp_path / "out" / "nodes").exists()
    with pytest.raises(ValueError):
        cli.convert(spark, f"{tmp_path}/src", f"{tmp_path}/out2", revision="main")
    with pytest.raises(ValueError):
        cli.convert(spark, f"{tmp_path}/src", f"{tmp_path}/out2", summary=f"{tmp_path}/out2/s.json")
    (tmp_path / "src" / "corp" / "set_TT" / "two.tt").write_text("<meta><norm>x</norm>")
    with pytest.raises(IntegrityError):
        cli.convert(spark, f"{tmp_path}/src", f"{tmp_path}/out3")
    assert not (tmp_path / "out3").exists()
