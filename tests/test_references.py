"""Reference resolution, audits, feature files and the streaming counters."""

from pyspark.sql import functions as F

from lectern.operators import audits
from lectern.operators.references import resolve_annotations, resolve_runs, verse_overlay, witness_violations, witnesses, word_overlay
from lectern.plans.graph import build_graph, digest
from lectern.plans.parse import REC, parse_records
from lectern.sources.features import read_feature, read_graph, read_header, write_feature, write_graph
from lectern.sources.markup import tag_events
from lectern.streaming.records import stream_records, stream_tag_counts
from lectern.tables import written


def ruth(meta="", body=""):
    return f'<meta {meta}><norm_group norm_group="g">{body}</norm_group>'


def verse(n, *words, vid=None, first=False):
    inner = "".join(f'<norm {"new_sent=\"true\"" if first and i == 0 else ""} norm="{w}">{w}</norm>' for i, w in enumerate(words))
    return f'<verse_n verse_n="{n}">{f"<vid_n vid_n=\"{vid}\">" if vid else ""}{inner}</verse_n>'


CTS = "urn:cts:copticLit:ot.ruth.x:2"
GOOD = f'document_cts_urn="{CTS}" chapter="2" book="Ruth"'


def test_cascade(spark):
    cases = {
        "r1": ("sahidic.ruth", ruth(GOOD, verse(1, "a", "b", vid=CTS + ".1", first=True) + verse(9, "c") + verse("x", "d"))),
        "r2": ("other", ruth(GOOD, verse(1, "a", first=True))),
        "r3": ("sahidic.ruth", ruth(GOOD.replace('chapter="2"', 'chapter="3"'), verse(1, "a", first=True))),
        "r4": ("sahidic.ruth", ruth(GOOD.replace('book="Ruth"', 'book="Jonah"'), verse(1, "a", first=True))),
        "r5": ("sahidic.ruth", ruth(GOOD, verse(1, "a", vid=CTS + ".7", first=True))),
        "r6": ("sahidic.ruth", ruth(GOOD, '<chapter_n chapter_n="5">' + verse(1, "a", first=True) + "</chapter_n>")),
        "r7": ("bohairic.ot", ruth('document_cts_urn="urn:cts:copticLit:ot.zach.bohairic_ed:02" chapter="2" book="Zechariah"', verse(3, "a", first=True) + verse(20, "b"))),
        "r8": ("bohairic.ot", ruth('document_cts_urn="urn:cts:copticLit:ot.pss.bohairic_ed:17" chapter="17" book="Psalms"', verse(1, "a", first=True))),
    }
    records = spark.createDataFrame([(k, corpus, bytearray(t.encode())) for k, (corpus, t) in cases.items()], f"{REC} string, corpus string, content binary")
    verses = spark.createDataFrame([("Ruth", 2, 1, 101), ("Ruth", 2, 7, 107), ("Zech", 2, 7, 207), ("Zech", 2, 3, 203), ("Ps", 17, 1, 301)], "book string, chapter int, verse int, node bigint")
    c = parse_records(records)
    reviewed = spark.createDataFrame([("r7",)], f"{REC} string").join(records, REC).select(REC, F.sha2("content", 256).alias("source_sha256"))
    r = written(resolve_runs(c, verses, "ed", reviewed), "resolved")
    got = {(x[REC], x["run"]): (x["status"], x["reason"], x["shared_id"]) for x in r.collect()}
    assert got["r1", 1] == ("reference_candidate", "address_exists", "ed:Ruth:2:1")
    assert got["r1", 2][:2] == ("unresolved", "address_absent") and got["r1", 3][:2] == ("unresolved", "no_number")
    assert got["r2", 1][:2] == ("unclassified_corpus", "corpus_not_reviewed")
    assert got["r3", 1][1] == "identity_contradicts_chapter" and got["r4", 1][1] == "book_contradicts" and got["r5", 1][1] == "identifier_contradicts" and got["r6", 1][1] == "chapter_conflict"
    assert got["r7", 1] == ("versification_candidate", "renumbered", "ed:Zech:2:7") and got["r7", 2][1] == "renumbering_not_reviewed"
    assert got["r8", 1][1] == "guarded"
    assert resolve_runs(c, verses, "ed").where(f"{REC} = 'r7' AND run = 1").collect()[0]["reason"] == "renumbering_not_reviewed"
    assert audits.uncovered_words(r, c.words).count() == 0 and audits.address_conflicts(r).count() == 0
    total = audits.coverage(r, c.documents).where("dimension = 'all'").collect()[0]
    assert (total["n_runs"], total["n_words"], total["n_addresses"]) == (11, 12, 2)
    g = build_graph(c)
    overlay, other = word_overlay(r, g.slots), verse_overlay(r)
    w = witnesses(overlay, "ed:Ruth:2:1").collect()
    assert [(x[REC], x["first"], x["last"]) for x in w] == [("r1", 1, 2)]
    assert witness_violations(overlay, other).count() == 0
    assert witness_violations(overlay, other.withColumn("n_spans", F.lit(0))).count() == 2


def test_annotations(spark):
    doc = "urn:cts:copticLit:nt.mark.sahidica_ed:4"
    body = '<verse_n verse_n="1"><verse_vid verse_vid="41N 4:1"><sbl_greek sbl_greek="x"><norm new_sent="true" norm="a">a</norm></sbl_greek><sbl_apparatus sbl_apparatus="y"></sbl_apparatus></verse_vid></verse_n>'
    texts = [ruth(f'book="Mark" chapter="4" document_cts_urn="{doc}"', body), ruth(f'book="Mark" chapter="5" document_cts_urn="{doc}"', body), ruth(f'book="Mark" book="Luke" chapter="4" document_cts_urn="{doc}"', body)]
    records = spark.createDataFrame([(f"m{i}", "sahidica.mark", bytearray(t.encode())) for i, t in enumerate(texts)], f"{REC} string, corpus string, content binary")
    sources = spark.createDataFrame([("sahidica.mark", "Mark", "mark", "41N", "Mark")], "corpus string, book string, work string, label string, book_name string")
    verses = spark.createDataFrame([("Mark", 4, 1, 7)], "book string, chapter int, verse int, node bigint")
    c = parse_records(records)
    got = {(x[REC], x["kind"]): (x["status"], x["reason"], x["shared_id"]) for x in resolve_annotations(c, sources, verses, "ed").collect()}
    assert got["m0", "sbl_greek"] == ("reference_candidate", "address_exists", "ed:Mark:4:1")
    assert got["m0", "sbl_apparatus"][:2] == ("unresolved", "no_whole_word")
    assert got["m1", "sbl_greek"][1] == "contradictory_address" and got["m2", "sbl_greek"][1] == "repeated_identity"
    assert resolve_annotations(c, sources, verses, "ed", [("Mark", 4, 1)]).where(f"{REC} = 'm0' AND kind = 'sbl_greek'").collect()[0]["status"] == "edition_unavailable"


def test_marker_audits_and_sinks(spark, tmp_path):
    text = ruth('license="" title="t"', verse(1, "a", first=True) + verse(2, "b") + verse(5, "c") + verse(5, "d") + verse(3, "e") + verse("x", "f"))
    records = spark.createDataFrame([("c/d:1", bytearray(text.encode()))], f"{REC} string, content binary")
    e = written(tag_events(records), "events")
    assert [x["step"] for x in audits.marker_topology(e).orderBy("seq").collect()] == ["first", "next", "gap", "duplicate", "decreasing", "invalid"]
    assert [x["missing"] for x in audits.verse_gaps(e).orderBy("missing").collect()] == [3, 4]
    c = parse_records(records).strict()
    assert audits.missing_metadata(c).count() == 1
    assert {x["table"]: x["n"] for x in audits.corpus_census(c).collect()}["words"] == 6
    g = build_graph(c)
    write_graph(g, f"{tmp_path}/graph")
    assert digest(read_graph(spark, f"{tmp_path}/graph")).collect() == digest(g).collect()
    odd = spark.createDataFrame([(3, "a\tb\\n\n"), (1, ""), (2, None)], "node_id bigint, value string")
    assert write_feature(odd, f"{tmp_path}/f", {"description": "odd"})
    assert sorted(map(tuple, read_feature(spark, f"{tmp_path}/f").collect())) == [(1, ""), (3, "a\tb\\n\n")]
    assert read_header(spark, f"{tmp_path}/f")["description"] == "odd"
    assert not write_feature(odd.where("node_id = 2"), f"{tmp_path}/g", {})


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.tt").write_text("<meta><note note=\"a\"></note><note note=\"b\"></note>")
    q = stream_tag_counts(stream_records(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("tags").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r["name"]: r["n_open"] for r in spark.table("tags").collect()} == {"meta": 1, "note": 2}
