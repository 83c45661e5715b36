"""Annotated text records as tables of tag events.

The only Python on the way from bytes to tables: a record's tags are found with
their attributes and the visible text before each. All that follows from the events
is window algebra (see ``plans.parse``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The forms of a tag and of an attribute.
TAG = re.compile(r"<(/?)([A-Za-z_][A-Za-z0-9_.:-]*)([^>]*)>")
ATTRIBUTE = re.compile(r'\s+([A-Za-z_][A-Za-z0-9_.:-]*)\s*=\s*"([^"]*)"')

EVENTS = "source_record_id string, seq int, closing boolean, name string, attrs map<string,string>, repeated map<string,array<string>>, piece string, problem string"


def visible(text: str) -> str:
    """Text with entities decoded and white space deleted."""
    return "".join(html.unescape(text).split())


def attributes(fragment: str) -> tuple[dict[str, str], dict[str, list[str]], str | None]:
    """First value of each attribute, all values of repeated ones, and what is wrong."""
    values: dict[str, list[str]] = {}
    at, end = 0, len(fragment.rstrip())
    while at < end:
        m = ATTRIBUTE.match(fragment, at)
        if m is None:
            return {k: v[0] for k, v in values.items()}, {}, "malformed_attributes"
        values.setdefault(m[1], []).append(html.unescape(m[2]))
        at = m.end()
    repeated = {k: v for k, v in values.items() if len(v) > 1}
    return {k: v[0] for k, v in values.items()}, repeated, None


def scan(content: bytes) -> list[tuple]:
    """(seq, closing, name, attrs, repeated, piece, problem) of each tag, then the text after the last one."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return [(0, None, None, {}, {}, "", "invalid_utf8")]
    if not text.strip():
        return [(0, None, None, {}, {}, "", "empty_record")]
    rows, at, seq = [], 0, 0
    for m in TAG.finditer(text):
        closing, name = bool(m[1]), m[2]
        attrs, repeated, problem = ({}, {}, None) if closing or (name == "meta" and seq) else attributes(m[3])
        if repeated and name != "meta":
            problem = problem or "repeated_attribute"
        if seq == 0 and (closing or name != "meta" or text[: m.start()].removeprefix("﻿").strip()):
            problem = "no_leading_metadata"
        rows.append((seq, closing, name, attrs, repeated, visible(text[at : m.start()]), problem))
        at, seq = m.end(), seq + 1
    rows.append((seq, None, None, {}, {}, visible(text[at:]), None if rows else "no_leading_metadata"))
    return rows


def tag_events(records: DataFrame) -> DataFrame:
    """records: source_record_id, content (binary). One row per tag, and one for the end of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.string()]
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for batch in batches:
            for key, content in zip(batch.column("source_record_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(key, s, c, n, list(a.items()), list(r.items()), p, e) for s, c, n, a, r, p, e in scan(content or b"")]
                for low in range(0, len(found), 20_000):
                    columns = zip(*found[low : low + 20_000], strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.selectExpr("cast(source_record_id as string) source_record_id", "cast(content as binary) content").mapInArrow(run, EVENTS)
