"""CoNLL-U side files: line grammar, alignment with the words of a record, and a ledger of outcomes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..operators.joins import cascade
from ..plans.parse import REC, Corpus

# The outcomes, and the order in which they are tried.
STATUSES = ("missing", "invalid_utf8", "placeholder", "malformed_conllu", "unsupported_conllu_shape", "token_alignment", "supplemented")
ROWS = f"{REC} string, sentence int, local int, form_literal string, form string, lemma string, upos string, xpos string, feats map<string,string>, head_local int, deprel string, misc map<string,string>, status string, detail string"

_WORD, _RANGE, _EMPTY = re.compile(r"[1-9][0-9]*"), re.compile(r"([1-9][0-9]*)-([1-9][0-9]*)"), re.compile(r"(0|[1-9][0-9]*)\.([1-9][0-9]*)")


class Malformed(ValueError):
    pass


def pairs(field: str) -> dict[str, str]:
    """k=v|k=v; nothing for an underscore."""
    out: dict[str, str] = {}
    for item in [] if field in ("", "_") else field.split("|"):
        key, sign, value = item.partition("=")
        if not sign or not key or key in out:
            raise Malformed(f"attribute {item!r}")
        out[key] = value
    return out


def read_sentence(lines: list[tuple[int, list[str]]]) -> tuple[list[tuple], str | None]:
    """Words of one sentence, and the shape that keeps it from being used, if any. Raises Malformed."""
    words, places, spans, empty, unsupported = [], {}, [], [], None
    for at, c in lines:
        if len(c) != 10:
            raise Malformed(f"line {at} has {len(c)} columns")
        if c[8] not in ("", "_"):
            unsupported = "enhanced dependencies"
        if _WORD.fullmatch(c[0]):
            number = int(c[0])
            if number != len(words) + 1:
                raise Malformed(f"word id {number} out of order")
            if not re.fullmatch("0|[1-9][0-9]*", c[6]):
                raise Malformed(f"head {c[6]!r}")
            places[number] = at
            none = [None if x == "_" else x for x in c]
            words.append((number, c[1], html.unescape(c[1]), none[2], none[3], none[4], pairs(c[5]), int(c[6]), none[7], pairs(c[9])))
        elif m := _RANGE.fullmatch(c[0]):
            spans.append((int(m[1]), int(m[2]), at))
        elif m := _EMPTY.fullmatch(c[0]):
            empty.append((int(m[1]), int(m[2]), at))
        else:
            raise Malformed(f"id {c[0]!r}")
    last = 0
    for first, end, at in sorted(spans):
        if first >= end or first <= last or end > len(words) or at >= places[first]:
            raise Malformed(f"multiword range {first}-{end}")
        last = end
    seen: dict[int, int] = {}
    for base, suffix, at in empty:
        after, before = places.get(base, 0 if base == 0 else None), places.get(base + 1)
        follows = [p for f, _, p in spans if f == base + 1]
        if after is None or suffix != seen.get(base, 0) + 1 or (base and at <= after) or (before is not None and at >= before) or (base and any(at >= p for p in follows)):
            raise Malformed(f"empty node {base}.{suffix}")
        seen[base] = suffix
    if any(w[7] > len(words) for w in words):
        raise Malformed("head outside the sentence")
    return words, "empty nodes" if empty else unsupported


def read_record(content: bytes) -> tuple[list[tuple[int, tuple]], str, str]:
    """((sentence, word) of all words, status, detail)."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return [], "invalid_utf8", str(e)
    if not text.strip():
        return [], "placeholder", ""
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    for at, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            blocks.append([])
        elif not line.startswith("#"):
            blocks[-1].append((at, line.split("\t")))
    out = []
    try:
        for n, block in enumerate((b for b in blocks if b), 1):  # the first sentence at fault decides
            words, shape = read_sentence(block)
            if shape:
                return [], "unsupported_conllu_shape", shape
            out += [(n, w) for w in words]
    except Malformed as e:
        return [], "malformed_conllu", str(e)
    return out, "supplemented", ""


def conllu_rows(records: DataFrame) -> DataFrame:
    """One row per word; one row without a word for a record that cannot be read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pa.map_(pa.string(), pa.string())
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5, m, pa.int32(), pa.string(), m, pa.string(), pa.string()]
        names = [x.split()[0] for x in ROWS.split(", ")]
        for batch in batches:
            for key, content in zip(batch.column(REC).to_pylist(), batch.column("content").to_pylist(), strict=True):
                words, status, detail = read_record(content or b"")
                rows = [(key, n, w[0], w[1], w[2], w[3], w[4], w[5], list(w[6].items()), w[7], w[8], list(w[9].items()), status, detail) for n, w in words]
                rows = rows or [(key, None, None, None, None, None, None, None, None, None, None, None, status, detail)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return records.select(REC, "content").mapInArrow(run, ROWS)


def supplement(c: Corpus, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words with ud_ columns, ledger). side: records of CoNLL-U files.

    A record is supplemented as a whole or not at all: the number of words, the sentences'
    sizes and every word's form must agree. Ledger: one row per record of either side,
    with ``without_counterpart`` for side files that no record asks for.
    """
    rows = conllu_rows(side).withColumn("fold", casefold(REC)).drop(REC)
    place = Window.partitionBy("fold").orderBy("sentence", "local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ordinal", F.when(F.col("local").isNotNull(), F.count("local").over(place)).cast("int"))
    start = F.col("ordinal") - F.col("local")
    rows = rows.withColumn("ud_head", F.when(F.col("head_local") == 0, 0).otherwise(start + F.col("head_local")).cast("int"))
    d = c.documents.select(REC, casefold(REC).alias("fold"))
    w = c.words.join(d, REC)
    joined = w.select("fold", "ordinal", "norm", "sentence").alias("w").join(rows.where("local IS NOT NULL").alias("u"), ["fold", "ordinal"], "full_outer")
    fits = F.coalesce((F.col("norm").eqNullSafe(F.col("form"))) & (F.col("w.sentence") == F.col("u.sentence")) & F.col("form").isNotNull(), F.lit(False))
    aligned = joined.groupBy("fold").agg(F.min(fits).alias("aligned"))
    read = rows.groupBy("fold").agg(F.first("status").alias("status"), F.first("detail").alias("detail"))
    ledger = d.join(read, "fold", "full_outer").join(aligned, "fold", "left")
    status = cascade([("without_counterpart", F.col(REC).isNull()), ("missing", F.col("status").isNull()), *((s, F.col("status") == s) for s in STATUSES[1:5]), ("token_alignment", ~F.coalesce("aligned", F.lit(True)))], "supplemented")
    ledger = ledger.select(REC, "fold", status.alias("status"), "detail")
    good = ledger.where("status = 'supplemented'").select("fold")
    ud = rows.where("local IS NOT NULL").join(good, "fold", "left_semi").select("fold", "ordinal", *(F.col(x).alias(f"ud_{x}") for x in ("form", "lemma", "upos", "xpos", "feats", "deprel", "misc")), "ud_head")
    return w.join(ud, ["fold", "ordinal"], "left").drop("fold"), ledger.drop("fold")
