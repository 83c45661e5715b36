"""Feature files: one sparse column per folder, as text that other tools can read.

A folder holds ``header`` (``@node`` or ``@edge``, then ``@key=value`` lines) and part files of
``node<TAB>value`` lines in node order. Nothing in the bytes depends on when or where they were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import metadata_feature, ud_feature


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescaped(c: Column) -> Column:
    marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(F.replace(marked, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def write_feature(df: DataFrame, path: str, metadata: dict[str, str], value_type: str = "str", kind: str = "node") -> bool:
    """df: node_id and value (for edges: src, dst and perhaps value). Null values are left out.

    Refuses a path that exists. Writes nothing, and returns False, if there is no value.
    """
    keys = ["node_id"] if kind == "node" else ["src", "dst"]
    rows = df.where(F.col("value").isNotNull()) if "value" in df.columns else df
    if rows.isEmpty():
        return False
    parts = [F.col(k).cast("string") for k in keys] + ([escaped(F.col("value").cast("string"))] if "value" in df.columns else [])
    lines = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.concat_ws("\t", *parts).alias("line"))
    lines.write.mode("errorifexists").text(f"{path}/rows")
    head = [f"@{kind}", *(["@edgeValues"] if kind == "edge" and "value" in df.columns else []), *(f"@{k}={v}" for k, v in sorted({**metadata, "valueType": value_type}.items()))]
    df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, line string").coalesce(1).sortWithinPartitions("i").select("line").write.mode("errorifexists").text(f"{path}/header")
    return True


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    lines = [r["value"] for r in spark.read.text(f"{path}/header").collect()]  # a few lines
    return {k.removeprefix("@"): v for k, _, v in (x.partition("=") for x in lines)}


def read_feature(spark: SparkSession, path: str) -> DataFrame:
    head = read_header(spark, path)
    cells = F.split("value", "\t")
    value = unescaped(cells[2 if "edge" in head else 1])
    value = value.cast("bigint") if head.get("valueType") == "int" else value
    rows = spark.read.text(f"{path}/rows")
    if "edge" in head:
        own = [cells[0].cast("bigint").alias("src"), cells[1].cast("bigint").alias("dst")]
        return rows.select(*own, *([value.alias("value")] if "edgeValues" in head else []))
    return rows.select(cells[0].cast("bigint").alias("node_id"), value.alias("value"))


#: Columns that say where a row stands and are no features of it.
_PLACES = ("node_id", "otype", "source_record_id", "source_ordinal", "ordinal", "first_slot", "last_slot", "slot_start", "seq")
MOST_KEYS = 10_000


def _keys(df: DataFrame, column: str) -> list[str]:
    """The keys of a map column. They become names of features; a corpus with more than MOST_KEYS is refused."""
    found = [r[0] for r in df.select(F.explode(F.map_keys(column))).distinct().limit(MOST_KEYS + 1).collect()]
    if len(found) > MOST_KEYS:
        raise ValueError(f"{column} has more than {MOST_KEYS} keys")
    return sorted(found)


def _named(df: DataFrame, column: str, name) -> dict[str, DataFrame]:
    """A feature for each key of a map column, under the name that name(key) makes; two keys of one name are refused."""
    keys = _keys(df, column)
    if not keys:
        return {}
    spark = df.sparkSession
    names = {r["key"]: r["name"] for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", name(F.col("key")).alias("name")).collect()}
    if len(set(names.values())) < len(names):
        raise ValueError(f"two keys of {column} make one feature name")
    return {names[k]: df.select("node_id", F.element_at(column, k).alias("value")) for k in keys}


def project(graph) -> dict[str, tuple[str, str, DataFrame]]:
    """All features of a graph: name -> (node or edge, str or int, rows).

    A column of words and of other nodes by the same name is one feature over both. Maps give a
    feature for each key: metadata and source attributes, and the attributes and notes of side files.
    """
    out: dict[str, tuple[str, str, DataFrame]] = {}
    parts: dict[str, list] = {"otype": [graph.slots.select("node_id", F.lit("word").alias("value")), graph.nodes.select("node_id", F.col("otype").alias("value"))]}
    types = {"otype": "str"}
    for df in (graph.slots, graph.nodes):
        for name, kind in df.dtypes:
            if name not in _PLACES and kind in ("string", "int", "bigint", "boolean"):
                value = F.col(name).cast("string" if kind in ("string", "boolean") else "bigint")
                types[name] = "str" if kind in ("string", "boolean") and types.get(name, "str") == "str" else "int"
                parts.setdefault(name, []).append(df.select("node_id", value.alias("value")))
    for name, rows in parts.items():
        rows = [r.select("node_id", F.col("value").cast("string" if types[name] == "str" else "bigint").alias("value")) for r in rows]
        out[name] = ("node", types[name], rows[0] if len(rows) == 1 else rows[0].union(rows[1]))
    out["oslots"] = ("node", "str", graph.nodes.where("first_slot IS NOT NULL").select("node_id", F.when(F.col("first_slot") == F.col("last_slot"), F.col("first_slot").cast("string")).otherwise(F.concat_ws("-", "first_slot", "last_slot")).alias("value")))
    maps: dict[str, DataFrame] = {}
    if "metadata" in graph.documents.columns:
        document = graph.nodes.where("otype = 'document'").select("node_id", "source_record_id")
        maps |= _named(document.join(graph.documents.select("source_record_id", "metadata"), "source_record_id"), "metadata", metadata_feature)
    if "source_attributes" in graph.nodes.columns:
        maps |= _named(graph.nodes.where("source_attributes IS NOT NULL"), "source_attributes", lambda k: F.concat(F.lit("source_"), metadata_feature(k)))
    for column, prefix in (("ud_feats", "feat"), ("ud_misc", "misc")):
        if column in graph.slots.columns:
            maps |= _named(graph.slots, column, lambda k, p=prefix: ud_feature(p, k))
    for name, rows in maps.items():
        if name in out:
            raise ValueError(f"two features are named {name}")
        out[name] = ("node", "str", rows)
    for kind in [r[0] for r in graph.edges.select("kind").distinct().collect()]:  # a few kinds
        e = graph.edges.where(F.col("kind") == kind)
        evidence = F.coalesce("classification", "target_id")
        valued = kind in ("same_scholarly", "documented_overlap", "witness")
        out[f"edge_{kind}" if kind in out else kind] = ("edge", "str", e.select("src", "dst", evidence.alias("value")) if valued else e.select("src", "dst"))
    return out


def _published(spark: SparkSession, path: str, write) -> None:
    """write(folder) fills a folder beside path, which is then renamed to it: what stands at path is whole. Refuses a path that exists."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target, part = jvm.Path(path), jvm.Path(f"{path}.part-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    try:
        write(part.toString())
        if files.exists(target) or not files.rename(part, target):
            raise FileExistsError(path)
    finally:
        files.delete(part, True)


def write_features(graph, path: str, metadata: dict[str, str] | None = None) -> list[str]:
    """Every feature in a folder of its own under a path that must not exist; the names of those with values."""
    graph.strict()
    names: list[str] = []

    def write(folder: str) -> None:
        for name, (kind, value_type, rows) in sorted(project(graph).items()):
            if write_feature(rows, f"{folder}/{name}", metadata or {}, value_type, kind):
                names.append(name)

    _published(graph.slots.sparkSession, path, write)
    return names


def write_graph(graph, path: str) -> None:
    """All tables of a graph as Parquet, in a folder that must not exist and appears as a whole; refused if the graph has violations."""
    graph.strict()

    def write(folder: str) -> None:
        for name in ("slots", "nodes", "edges", "documents"):
            getattr(graph, name).write.mode("errorifexists").parquet(f"{folder}/{name}")

    _published(graph.slots.sparkSession, path, write)


def read_graph(spark: SparkSession, path: str):
    from ..plans.graph import Graph, validate

    t = {name: spark.read.parquet(f"{path}/{name}") for name in ("slots", "nodes", "edges", "documents")}
    return Graph(**t, violations=validate(t["slots"], t["nodes"], t["edges"]))
