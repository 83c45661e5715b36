"""Scalar functions: Spark expressions, and the few that need Python."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python counts as white space, for Java regular expressions.
WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding; the JVM's lower() differs for some letters."""
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfd_letters(s: pd.Series) -> pd.Series:
    """The letters left after canonical decomposition, lower-cased."""
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t).casefold() if c.isalpha()), na_action="ignore")


def without_white(c: Column) -> Column:
    return F.regexp_replace(c, WHITE, "")


def positive_int(c: Column) -> Column:
    """A whole string of ASCII digits above zero, as a number; else null."""
    return F.when(c.rlike(r"\A[0-9]+\z"), F.nullif(c.try_cast("decimal(38,0)"), F.lit(0)))


def verse_number(literal: Column, book: Column, chapter: Column) -> Column:
    """A bare number, or "Book C:V" that agrees with book and chapter."""
    cited_book = F.regexp_extract(literal, r"\A(.+) ([0-9]+):([0-9]+)\z", 1)
    cited_chapter = positive_int(F.regexp_extract(literal, r"\A(.+) ([0-9]+):([0-9]+)\z", 2))
    cited = positive_int(F.regexp_extract(literal, r"\A(.+) ([0-9]+):([0-9]+)\z", 3))
    return F.coalesce(positive_int(literal), F.when((cited_book == book) & (cited_chapter == chapter), cited))


def literal_shape(c: Column) -> Column:
    """missing, number, chapter_verse, cts_verse, or other."""
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "missing").when(c.rlike(r"\A[0-9]+\z"), "number").when(c.rlike(r"\A.*[0-9]+:[0-9]+\z") & ~c.startswith("urn:"), "chapter_verse")
        .when(c.startswith("urn:cts:"), "cts_verse").otherwise("other")
    )


def invalid_literal(c: Column) -> Column:
    """Why a literal is no positive number; null if it is one."""
    return (
        F.when(c.isNull(), "missing").when(c == "", "empty").when(c.rlike(r"\A0+\z"), "zero").when(c.rlike(r"\A[+-][0-9]+\z"), "signed")
        .when(~c.rlike(r"\A[0-9]+\z"), "nondecimal")
    )


def is_clean_cts(c: Column) -> Column:
    """Five non-empty colon parts, the first two urn and cts, no blanks."""
    parts = F.split(c, ":")
    return (F.size(parts) >= 4) & (parts[0] == "urn") & (parts[1] == "cts") & ~F.exists(parts, lambda p: p == "") & ~c.rlike(r"\s")


def metadata_feature(key: Column) -> Column:
    """meta_<key>, or meta__hex_<bytes> where the key is no safe name."""
    safe = key.rlike(r"\A[a-z][a-z0-9_]*\z") & ~key.rlike(r"__[0-9]+\z")
    return F.when(safe, F.concat(F.lit("meta_"), key)).otherwise(F.concat(F.lit("meta__hex_"), F.lower(F.hex(F.encode(key, "utf-8")))))


def ud_feature(prefix: str, key: Column) -> Column:
    """ud_<prefix>_<snake case of key>, brackets as underscores; hex where that is no safe name."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(key, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"\[([A-Za-z0-9]+)\]", "_$1"))
    return F.concat(F.lit(f"ud_{prefix}_"), F.when(snake.rlike(r"\A[a-z][a-z0-9_]*\z"), snake).otherwise(F.concat(F.lit("hex_"), F.lower(F.hex(F.encode(key, "utf-8"))))))


def git_blob_sha(content: Column) -> Column:
    """sha1 of a binary column as git names blobs."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.lit(bytearray(b"\0")), content))


def mismatch_category(left: Column, right: Column) -> Column:
    """How two values of a field relate."""
    return (
        F.when(left.isNull() & right.isNull(), "equal").when(left.isNull(), "missing_left").when(right.isNull(), "missing_right").when(left == right, "equal")
        .when(html_unescape(left) == html_unescape(right), "serialization_equivalent").otherwise("different")
    )
