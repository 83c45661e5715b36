"""Where records lie: folders and archives, as one table of bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold

RECORDS = "source_record_id string, source_path string, packaging string, corpus string, dataset string, record string, source_sha256 string, content binary"


def read_records(spark: SparkSession, root: str, kind: str = "TT", suffix: str = ".tt") -> DataFrame:
    """All records under root: ``corpus/dataset_KIND/record.suffix``, loose or in ``corpus/dataset_KIND.zip``.

    Archives are opened by the task that reads them; members lie at the root or in a folder ``dataset_KIND``.
    """
    relative = F.regexp_extract("path", r"([^/]+/[^/]+(?:/[^/]+)?)\z", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    loose = files.option("pathGlobFilter", f"*{suffix}").load(root).withColumn("rel", F.regexp_extract("path", rf"([^/]+/[^/]+_{kind}/[^/]+){'$'}", 1)).where("rel != ''")
    parts = F.split("rel", "/")
    loose = loose.select(F.regexp_replace(parts[1], f"_{kind}$", "").alias("dataset"), parts[0].alias("corpus"), F.regexp_replace(parts[2], rf"\{suffix}$", "").alias("record"), F.col("rel").alias("source_path"), F.lit("directory").alias("packaging"), "content")
    zips = files.option("pathGlobFilter", f"*_{kind}.zip").load(root).withColumn("rel", relative)
    packed = zips.select(F.regexp_extract("path", r"([^/]+/[^/]+\.zip)\z", 1).alias("rel"), "content").mapInArrow(_members(kind, suffix), "dataset string, corpus string, record string, source_path string, packaging string, content binary")
    both = loose.unionByName(packed)
    key = F.concat_ws("", F.concat_ws("/", "corpus", "dataset"), F.lit(":"), "record")
    return both.select(key.alias("source_record_id"), "source_path", "packaging", "corpus", "dataset", "record", F.sha2("content", 256).alias("source_sha256"), "content")


def _members(kind: str, suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist(), strict=True):
                corpus, archive = rel.split("/")
                dataset = archive.removesuffix(f"_{kind}.zip")
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        short = name.removeprefix(f"{dataset}_{kind}/")
                        if "/" not in short and short.endswith(suffix):
                            yield pa.record_batch({"dataset": [dataset], "corpus": [corpus], "record": [short.removesuffix(suffix)], "source_path": [f"{rel}!/{name}"], "packaging": ["archive"], "content": pa.array([z.read(name)], pa.binary())})

    return run


def layout_violations(spark: SparkSession, root: str, kind: str = "TT", suffix: str = ".tt") -> DataFrame:
    """(rule, key): files and archive members that read_records leaves out, and archives without a record.

    A conversion refuses a tree with any, so that nothing is left out in silence. Only names are read of loose files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    own = F.regexp_extract("path", rf"/([^/]+/[^/]+_{kind}/.+)\z", 1)
    loose = files.load(root).select(own.alias("key")).where("key != ''")
    depth = F.size(F.split("key", "/"))
    loose = loose.select(F.when(depth != 3, "nested_record").when(~F.col("key").endswith(suffix), "unsupported_file").alias("rule"), "key").where("rule IS NOT NULL")
    zips = files.option("pathGlobFilter", f"*_{kind}.zip").load(root).select(F.regexp_extract("path", r"([^/]+/[^/]+\.zip)\z", 1).alias("rel"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist(), strict=True):
                dataset, found, rows = rel.split("/")[-1].removesuffix(f"_{kind}.zip"), 0, []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            short = info.filename.removeprefix(f"{dataset}_{kind}/")
                            if info.is_dir():
                                continue
                            if (info.external_attr >> 16) & 0o170000 == 0o120000:
                                rows.append(("linked_member", f"{rel}!/{info.filename}"))
                            elif "/" in short:
                                rows.append(("nested_member", f"{rel}!/{info.filename}"))
                            elif not short.endswith(suffix):
                                rows.append(("unsupported_member", f"{rel}!/{info.filename}"))
                            else:
                                found += 1
                    if not found:
                        rows.append(("empty_dataset", rel))
                except zipfile.BadZipFile:
                    rows.append(("broken_archive", rel))
                yield pa.record_batch({"rule": pa.array([r for r, _ in rows], pa.string()), "key": pa.array([k for _, k in rows], pa.string())})

    return loose.union(zips.mapInArrow(run, "rule string, key string"))


def record_violations(records: DataFrame) -> DataFrame:
    """(rule, key): ids that collide when case is folded, and paths without a corpus or dataset."""
    clash = records.groupBy(casefold("source_record_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_record_id").alias("rule"), "key")
    bare = records.where("corpus = '' OR dataset = '' OR record = ''").select(F.lit("invalid_record_id").alias("rule"), F.col("source_path").alias("key"))
    return clash.union(bare)
