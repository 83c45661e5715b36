"""The audits' counters over records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.markup import tag_events


def stream_records(spark: SparkSession, root: str, suffix: str = ".tt") -> DataFrame:
    """New record files under root, as a stream."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(F.regexp_extract("path", rf"([^/]+)\{suffix}\z", 1).alias("source_record_id"), "content")


def stream_tag_counts(records: DataFrame) -> DataFrame:
    """Openings of each tag so far."""
    return tag_events(records).where("name IS NOT NULL AND NOT closing").groupBy("name").agg(F.count("*").alias("n_open"))
