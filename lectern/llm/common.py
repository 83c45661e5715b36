"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import importlib.util
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import mix  # noqa: F401 (used by the operators)

#: A word, as the contracts give it, for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_folders: dict[str, str] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables.

    It lies in ``spark.checkpoint.dir``, which all executors share. Only on a local master,
    where the driver is the one executor, may that be unset: a temporary folder takes its place.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is unset: the executors share no folder for intermediate tables")
            base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        _folders[app] = f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended first
        pass


#: Spark's own limit of an Arrow batch; what operators set it to where nobody else has (its default is 64 MB).
_BATCH, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, however long the texts are."""
    if spark.conf.get(_BATCH, None) in (f"{_DEFAULT}b", str(_DEFAULT), "64m"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Hand what was freed back to the system: allocators keep it otherwise, and the worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries have none
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, with the memory of each task given back at its end."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


#: Spark's own setting: what an execution has shuffled goes when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and return the written table.

    This cuts the lineage: what follows neither computes df again nor depends
    on an executor that may be lost. What was shuffled for it is deleted.
    """
    spark, schema = df.sparkSession, df.schema
    small_batches(spark)
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote and that nothing will read any more."""
    for df in tables:
        _, path = _paths.pop(id(df), (None, None))
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def sheltered(df: DataFrame, *names: str):
    """df with all columns but names under names of their own, and a function that gives them back.

    With this an operator's own columns cannot clash with any that it carries.
    """
    before = df.columns
    inside = [c if c in names else f"__carried_{i}" for i, c in enumerate(before)]
    return df.toDF(*inside), lambda out: out.select(*inside).toDF(*before)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_bucket(column: str, modulus: int):
    """crc32 of an integer column's text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine.

    The installed ``public_tokenizers`` package knows it; the folder
    /opt/tokenizers, or LECTERN_TOKENIZERS, stands in where it is missing.
    """
    if importlib.util.find_spec("public_tokenizers") is None:
        return os.path.join(os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers"), name)
    import public_tokenizers

    return public_tokenizers.path(name)
