"""Runs of words and annotations matched to verse addresses of another corpus, by rules tried in order.

A match is a candidate address, never a claim that two texts agree. The other corpus is
a table (book, chapter, verse, node); its edition's name is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import positive_int, verse_number
from ..plans.parse import REC, Corpus
from .joins import cascade
from .windows import runs

# Corpora of a single book, and corpora of many works.
BOOK_OF_CORPUS = {"sahidic.ruth": "Ruth", "sahidic.jonah": "Jonah", "bohairic-jonah": "Jonah", "bohairic-habakkuk": "Hab", "bohairic.habakkuk": "Hab"}
CORPORA_OF_WORKS = ("sahidic.ot", "bohairic.ot", "coptic-treebank", "bohairic-treebank")
# Work names in identifiers, with the book's code.
BOOK_OF_WORK = {
    "gen": "Gen", "exod": "Exod", "lev": "Lev", "num": "Num", "deut": "Deut", "josh": "Josh", "judg": "Judg", "ruth": "Ruth", "1sam": "1Sam", "2sam": "2Sam", "1kgs": "1Kgs", "2kgs": "2Kgs",
    "1chr": "1Chr", "2chr": "2Chr", "2macc": "2Mac", "esth": "Esth", "jdt": "Jdt", "pss": "Ps", "prov": "Prov", "eccl": "Qoh", "song": "Cant", "job": "Job", "wis": "Wis", "sir": "Sir",
    "hos": "Hos", "mic": "Mic", "amos": "Amos", "joel": "Joel", "jonah": "Jonah", "obad": "Obad", "nah": "Nah", "hab": "Hab", "zeph": "Zeph", "hag": "Hag", "zach": "Zech", "zech": "Zech", "mal": "Mal",
    "isa": "Isa", "jer": "Jer", "bar": "Bar", "epjer": "EpJer", "lam": "Lam", "ezek": "Ezek",
}
# Book names in metadata and labels.
BOOK_OF_NAME = {
    "ruth": "Ruth", "jonah": "Jonah", "habakkuk": "Hab", "hab": "Hab", "genesis": "Gen", "exodus": "Exod", "leviticus": "Lev", "numbers": "Num", "deuteronomy": "Deut",
    "psalms": "Ps", "psalm": "Ps", "ecclesiastes": "Qoh", "song of songs": "Cant", "zechariah": "Zech",
}
# Forms of identifiers and labels.
DOCUMENT_CTS = r"\Aurn:cts:copticLit:ot\.([A-Za-z0-9_-]+)\.[^:]+:([0-9]+)\z"
VERSE_CTS = r"\Aurn:cts:copticLit:ot\.([A-Za-z0-9_-]+)\.[^:]+:([0-9]+)\.([0-9]+)\z"
VERSE_LABEL = r"\A([A-Za-z][A-Za-z ]*) ([0-9]+):([0-9]+)\z"
# A renumbered edition: (source chapter, first verse, last verse, target chapter, offset).
RENUMBERED = {"corpus": "bohairic.ot", "book": "Zech", "cts": "urn:cts:copticLit:ot.zach.bohairic_ed:%02d", "rules": ((1, 18, 21, 2, -17), (2, 1, 13, 2, 4)), "suspect": ((1, 18), (2, 1))}
# Chapters whose first verses are known not to be the same-numbered ones.
GUARDED = {"corpus": "bohairic.ot", "book": "Ps", "cts": "urn:cts:copticLit:ot.pss.bohairic_ed:%02d", "chapters": (3, 17, 51), "verses": (1, 2)}
CANDIDATES = ("reference_candidate", "versification_candidate")


def _dim(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def only(value: str) -> Column:
    """The single value among those that are not null; null if there are several."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def verse_runs(c: Corpus) -> DataFrame:
    """Maximal runs of words of one verse literal, cut where a chapter begins: first, last, their markers."""
    starts = c.annotations.where("kind = 'chapter_n'").select(REC, (F.col("start_after") + 1).alias("ordinal"), F.lit(1).alias("cut")).distinct()
    w = c.words.join(starts, [REC, "ordinal"], "left")
    epoch = Window.partitionBy(REC).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = runs(w.withColumn("epoch", F.coalesce(F.sum("cut").over(epoch), F.lit(0))), [REC], ["ordinal"], ["verse_n", "epoch"])
    out = w.groupBy(REC, F.col("run").cast("int").alias("run")).agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min("verse_n").alias("verse_n"), only("vid_n").alias("vid_n"), only("verse_vid").alias("verse_vid"),
        (F.min("vid_n") != F.max("vid_n")).alias("vid_conflict"), (F.min("verse_vid") != F.max("verse_vid")).alias("label_conflict"), F.count("vid_n").alias("n_vid"), F.count("verse_vid").alias("n_label"))
    return out.withColumns({"vid_conflict": F.coalesce("vid_conflict", F.lit(False)), "label_conflict": F.coalesce("label_conflict", F.lit(False))})


def source_books(documents: DataFrame) -> DataFrame:
    """documents with book, chapter and issue: what a record says it is, and what contradicts that."""
    meta = lambda k: F.element_at("metadata", k)
    cts = F.coalesce(F.trim(meta("document_cts_urn")), F.lit(""))
    own = _dim(BOOK_OF_CORPUS, F.col("corpus"))
    works = F.col("corpus").isin(*CORPORA_OF_WORKS)
    work = _dim(BOOK_OF_WORK, F.lower(F.regexp_extract(cts, DOCUMENT_CTS, 1)))
    valid, chapter = cts.rlike(DOCUMENT_CTS), positive_int(meta("chapter"))
    cited = positive_int(F.regexp_extract(cts, DOCUMENT_CTS, 2))
    issue = cascade([
        ("corpus_not_reviewed", own.isNull() & ~works), ("no_work_identity", (cts == "") & works), ("none", cts == ""), ("invalid_identity", ~valid), ("work_not_reviewed", work.isNull()),
        ("identity_contradicts_corpus", own.isNotNull() & (own != work)), ("identity_contradicts_chapter", cited.isNull() | ~cited.eqNullSafe(chapter)),
    ], "none")
    book = F.when(issue.isin("corpus_not_reviewed", "no_work_identity", "work_not_reviewed"), None).when((cts == "") | ~valid, own).when(issue == "identity_contradicts_corpus", own).otherwise(work)
    return documents.withColumns({"book": book, "chapter": chapter.cast("bigint"), "issue": F.nullif(issue, F.lit("none")), "cts": cts, "named": _dim(BOOK_OF_NAME, F.lower(F.trim(meta("book")))), "has_name": meta("book").isNotNull()})


def resolve_runs(c: Corpus, verses: DataFrame, edition: str, reviewed: DataFrame | None = None) -> DataFrame:
    """Every run with status, reason, target and shared_id. The first rule that fits decides.

    verses: book, chapter, verse, node. reviewed: (source_record_id, source_sha256) of the exact files for
    which the renumbering rules were checked; other files of those works get no same-number match.
    """
    d = source_books(c.documents)
    if "source_sha256" not in d.columns:
        d = d.withColumn("source_sha256", F.sha2("content", 256))
    known = d.join(reviewed.withColumn("checked", F.lit(True)), [REC, "source_sha256"], "left") if reviewed is not None else d.withColumn("checked", F.lit(None).cast("boolean"))
    known = known.select(REC, "corpus", "book", "chapter", "issue", "cts", "named", "has_name", F.coalesce("checked", F.lit(False)).alias("checked"))
    r = verse_runs(c).join(known, REC).withColumn("verse", positive_int(F.col("verse_n")).cast("bigint"))
    marks = c.annotations.where("kind = 'chapter_n'").select(F.col(REC).alias("__r"), F.col("ordinal").alias("__o"), F.col("start_after").alias("__after"), F.col("start_word").alias("__in"), positive_int(F.col("value")).cast("bigint").alias("__chapter"))
    risk = r.join(marks, (F.col(REC) == F.col("__r")) & (F.col("__after") < F.col("last")))
    inside, other = F.col("__in").between(F.col("first"), F.col("last")), ~F.col("__chapter").eqNullSafe(F.col("chapter"))
    risk = risk.groupBy(REC, "run").agg(F.min_by(F.when(F.coalesce(inside, F.lit(False)), "chapter_inside_word").otherwise("chapter_conflict"), F.when(F.coalesce(inside, F.lit(False)) | other | F.col("__chapter").isNull(), F.col("__o"))).alias("chapter_risk"))
    r = r.join(risk, [REC, "run"], "left")
    part = lambda c, form, i: F.regexp_extract(c, form, i)
    as_number = lambda c: c.try_cast("bigint")
    cts_fits = F.col("vid_n").rlike(VERSE_CTS) & _dim(BOOK_OF_WORK, F.lower(part("vid_n", VERSE_CTS, 1))).eqNullSafe(F.col("book")) & (as_number(part("vid_n", VERSE_CTS, 2)) == F.col("chapter")) & (as_number(part("vid_n", VERSE_CTS, 3)) == F.col("verse"))
    label_fits = F.col("verse_vid").rlike(VERSE_LABEL) & _dim(BOOK_OF_NAME, F.lower(F.trim(part("verse_vid", VERSE_LABEL, 1)))).eqNullSafe(F.col("book")) & (as_number(part("verse_vid", VERSE_LABEL, 2)) == F.col("chapter")) & (as_number(part("verse_vid", VERSE_LABEL, 3)) == F.col("verse"))
    fmt = lambda form: F.concat(F.lit(form.split("%")[0]), F.lpad(F.col("chapter").cast("string"), 2, "0"))
    guarded = (F.col("book") == GUARDED["book"]) & (F.col("corpus") == GUARDED["corpus"]) & F.col("chapter").isin(*GUARDED["chapters"]) & F.col("verse").isin(*GUARDED["verses"]) & (F.col("cts") == fmt(GUARDED["cts"]))
    zone = (F.col("book") == RENUMBERED["book"]) & (F.col("corpus") == RENUMBERED["corpus"])
    edition_known = F.col("cts") == fmt(RENUMBERED["cts"])
    suspect, shifted_chapter, shifted = F.lit(False), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for chapter, low in RENUMBERED["suspect"]:
        suspect = suspect | ((F.col("chapter") == chapter) & (F.col("verse") >= low))
    for chapter, low, high, target, offset in RENUMBERED["rules"]:
        fits = zone & edition_known & (F.col("chapter") == chapter) & F.col("verse").between(low, high)
        shifted_chapter, shifted = F.when(fits, target).otherwise(shifted_chapter), F.when(fits, F.col("verse") + offset).otherwise(shifted)
    r = r.withColumns({"shifted": shifted.cast("bigint"), "to_chapter": F.coalesce(shifted_chapter, F.col("chapter")).cast("bigint")}).withColumn("to_verse", F.coalesce("shifted", "verse"))
    v = verses.select(F.col("book").alias("__b"), F.col("chapter").cast("bigint").alias("__c"), F.col("verse").cast("bigint").alias("__v"), "node")
    r = r.join(v, (F.col("book") == F.col("__b")) & (F.col("to_chapter") == F.col("__c")) & (F.col("to_verse") == F.col("__v")), "left").drop("__b", "__c", "__v")
    name_conflict = F.col("has_name") & ~F.col("named").eqNullSafe(F.col("book"))
    blocked = zone & ((suspect & (~edition_known | F.col("shifted").isNull())) | (F.col("shifted").isNotNull() & ~F.col("checked")))
    rules = [
        ("no_book", F.col("book").isNull()), ("record_issue", F.col("issue").isNotNull()), ("chapter_risk", F.col("chapter_risk").isNotNull()), ("no_number", F.col("chapter").isNull() | F.col("verse").isNull()),
        ("contradictory_markers", F.col("vid_conflict") | F.col("label_conflict")), ("book_contradicts", name_conflict), ("identifier_contradicts", (F.col("n_vid") > 0) & ~F.coalesce(cts_fits, F.lit(False))),
        ("label_contradicts", (F.col("n_label") > 0) & ~F.coalesce(label_fits, F.lit(False))), ("guarded", guarded), ("renumbering_not_reviewed", blocked), ("address_absent", F.col("node").isNull()),
        ("renumbered", F.col("shifted").isNotNull()),
    ]
    rule = cascade(rules, "address_exists")
    status = _dim({"no_book": "unclassified_corpus", "no_number": "unresolved", "address_absent": "unresolved", "renumbered": CANDIDATES[1], "address_exists": CANDIDATES[0]}, F.col("rule"))
    r = r.withColumn("rule", rule).withColumn("status", F.coalesce(status, F.lit("ambiguous")))
    found = F.col("status").isin(*CANDIDATES)
    shared = F.when(found, F.concat_ws(":", F.lit(edition), "book", F.col("to_chapter").cast("string"), F.col("to_verse").cast("string")))
    reason = F.when(F.col("rule").isin("no_book", "record_issue"), F.col("issue")).when(F.col("rule") == "chapter_risk", F.col("chapter_risk")).otherwise(F.col("rule"))
    return r.select(REC, "run", "first", "last", "verse_n", "vid_n", "verse_vid", "book", F.col("to_chapter").alias("chapter"), F.col("to_verse").alias("verse"), F.when(found, F.col("node")).alias("node"), shared.alias("shared_id"), "status", reason.alias("reason"))


def word_overlay(resolved: DataFrame, slots: DataFrame) -> DataFrame:
    """Features of each word by node id, from the run it lies in."""
    r = resolved.select(F.col(REC).alias("__r"), "first", "last", "status", "reason", F.col("shared_id").alias("ref_id"))
    w = slots.select("node_id", REC, "ordinal", "verse_n").join(r, (F.col(REC) == F.col("__r")) & F.col("ordinal").between(F.col("first"), F.col("last")))
    return w.select("node_id", REC, "ordinal", "verse_n", "ref_id", "status", "reason")


def verse_overlay(resolved: DataFrame) -> DataFrame:
    """For each address of the other corpus its shared id and how many runs point to it."""
    return resolved.where(F.col("node").isNotNull()).groupBy("node", F.col("shared_id").alias("ref_id")).agg(F.count("*").alias("n_spans"))


def witnesses(overlay: DataFrame, ref_id: str) -> DataFrame:
    """From an address back to the runs of words that carry it: record, status, verse literal, first and last word."""
    w = runs(overlay.where(F.col("ref_id") == ref_id), [REC], ["ordinal"], ["status", "verse_n"], ordinal="ordinal")
    return w.groupBy(REC, "run").agg(F.min("status").alias("status"), F.min("verse_n").alias("verse_n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node")).drop("run")


def witness_violations(overlay: DataFrame, verses: DataFrame) -> DataFrame:
    """Addresses whose declared number of runs is smaller than what the words show, statuses that carry no address, and repeated words."""
    w = runs(overlay.where("ref_id IS NOT NULL"), [REC], ["ordinal"], ["ref_id", "status", "verse_n"], ordinal="ordinal")
    seen = w.select("ref_id", REC, "run").distinct().groupBy("ref_id").agg(F.count("*").alias("seen"))
    short = seen.join(verses, "ref_id", "left").where("n_spans IS NULL OR n_spans < seen").select(F.lit("span_count").alias("rule"), F.col("ref_id").alias("key"))
    bad = overlay.where(F.col("ref_id").isNotNull() & ~F.col("status").isin(*CANDIDATES)).select(F.lit("status_without_address").alias("rule"), F.col("ref_id").alias("key"))
    twice = overlay.groupBy("node_id").count().where("count > 1").select(F.lit("repeated_word").alias("rule"), F.col("node_id").cast("string").alias("key"))
    return short.union(bad).union(twice)


def resolve_annotations(c: Corpus, sources: DataFrame, verses: DataFrame, edition: str, absent: list[tuple[str, int, int]] = ()) -> DataFrame:
    """One row per source annotation, by the references of the words it holds as a whole.

    sources: corpus, book, work, label, book_name: the reviewed ones. absent: addresses that the edition leaves out.
    """
    meta = lambda k: F.trim(F.element_at("metadata", k))
    identity = F.array(*(F.lit(k) for k in ("book", "chapter", "corpus", "document_cts_urn")))
    d = c.documents.select(REC, "corpus", meta("book").alias("named"), positive_int(meta("chapter")).cast("bigint").alias("chapter"), meta("document_cts_urn").alias("cts"), F.arrays_overlap(F.map_keys("metadata_duplicates"), identity).alias("repeated"))
    d = d.join(sources, "corpus", "left").withColumn("attested", F.col("work").isNotNull() & (F.col("named") == F.col("book_name")))
    a = c.annotations.where("track = 'sbl'").join(d, REC)
    w = c.words.select(F.col(REC).alias("__r"), F.col("ordinal").alias("__w"), "verse_n", "vid_n", "verse_vid")
    single = lambda x: (F.countDistinct(x) + F.max(F.when(F.col("__w").isNotNull() & F.col(x).isNull(), 1).otherwise(0))) <= 1
    held = a.join(w, (F.col(REC) == F.col("__r")) & F.col("__w").between(F.col("first_full"), F.col("last_full")), "left")
    keys = [REC, "kind", "ordinal", "source_verse_n", "book", "work", "label", "chapter", "cts", "repeated", "attested"]
    g = held.groupBy(*keys).agg(F.count("__w").alias("n_words"), F.min("verse_n").alias("verse_n"), F.min("vid_n").alias("vid_n"), F.min("verse_vid").alias("verse_vid"), (single("verse_n") & single("vid_n") & single("verse_vid")).alias("unanimous"))
    g = g.withColumn("verse", verse_number(F.col("source_verse_n"), F.regexp_replace("book", "_", " "), F.col("chapter")).cast("bigint"))
    v = verses.select(F.col("book").alias("__b"), F.col("chapter").cast("bigint").alias("__c"), F.col("verse").cast("bigint").alias("__v"), "node")
    g = g.join(v, (F.col("book") == F.col("__b")) & (F.col("chapter") == F.col("__c")) & (F.col("verse") == F.col("__v")), "left")
    number = lambda c, form, i: F.regexp_extract(c, form, i).try_cast("bigint")
    doc, ver, lab = r"\Aurn:cts:copticLit:nt\.([a-z0-9]+)\.[^:]+:([1-9][0-9]*)\z", r"\Aurn:cts:copticLit:nt\.([a-z0-9]+)\.[^:]+:([1-9][0-9]*)\.([1-9][0-9]*)\z", r"\A([0-9A-Z]+) ([1-9][0-9]*):([1-9][0-9]*)\z"
    malformed = ~F.col("cts").rlike(doc) | ~F.col("verse_vid").rlike(lab) | (F.col("vid_n").isNotNull() & ~F.col("vid_n").rlike(ver)) | F.col("verse_vid").isNull() | F.col("cts").isNull()
    agrees = (F.regexp_extract("cts", doc, 1) == F.col("work")) & (number("cts", doc, 2) == F.col("chapter")) & (F.regexp_extract("verse_vid", lab, 1) == F.col("label")) & (number("verse_vid", lab, 2) == F.col("chapter")) & (number("verse_vid", lab, 3) == F.col("verse"))
    agrees = agrees & (F.col("vid_n").isNull() | ((F.regexp_extract("vid_n", ver, 1) == F.col("work")) & (number("vid_n", ver, 2) == F.col("chapter")) & (number("vid_n", ver, 3) == F.col("verse"))))
    gone = F.lit(False)
    for book, chapter, verse in absent:
        gone = gone | ((F.col("book") == book) & (F.col("chapter") == chapter) & (F.col("verse") == verse))
    rules = [
        ("repeated_identity", F.col("repeated")), ("source_not_reviewed", ~F.coalesce("attested", F.lit(False))), ("no_whole_word", F.col("n_words") == 0),
        ("contradictory_markers", ~F.col("unanimous") | ~F.col("source_verse_n").eqNullSafe(F.col("verse_n"))), ("malformed_evidence", malformed), ("contradictory_address", ~F.coalesce(agrees, F.lit(False))),
        ("absent_from_edition", gone), ("address_absent", F.col("node").isNull()),
    ]
    rule = cascade(rules, "address_exists")
    status = _dim({"source_not_reviewed": "unclassified_source", "no_whole_word": "unresolved", "absent_from_edition": "edition_unavailable", "address_absent": "unresolved", "address_exists": "reference_candidate"}, F.col("reason"))
    g = g.withColumn("reason", rule).withColumn("status", F.coalesce(status, F.lit("ambiguous")))
    shared = F.when(F.col("status") == "reference_candidate", F.concat_ws(":", F.lit(edition), "book", F.col("chapter").cast("string"), F.col("verse").cast("string")))
    return g.select(REC, "kind", "ordinal", "n_words", "source_verse_n", "vid_n", "verse_vid", "book", "chapter", "verse", F.when(shared.isNotNull(), F.col("node")).alias("node"), shared.alias("shared_id"), "status", "reason")
