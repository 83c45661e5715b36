"""Convert a folder of records to a graph, with a JSON summary."""

from __future__ import annotations

import argparse
import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.audits import corpus_census, missing_metadata
from .operators.relations import derive_relations, unresolved_witnesses
from .plans.graph import build_graph, digest
from .plans.parse import IntegrityError, parse_records
from .sources.conllu import supplement
from .sources.features import write_graph
from .sources.records import layout_violations, read_records, record_violations

LOCAL = "local"


def valid_revision(revision: str) -> str:
    """40 or 64 hex digits, or the word for an unversioned tree."""
    if revision != LOCAL and not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", revision):
        raise ValueError(f"not a revision: {revision!r}")
    return revision


def summary_path(path: str | None, destination: str) -> str | None:
    """A summary goes to a new file outside the destination."""
    if path is None:
        return None
    own, target = os.path.realpath(path), os.path.realpath(destination)
    if os.path.exists(own) or os.path.commonpath([own, target]) == target:
        raise ValueError(f"the summary needs a new path outside {destination}")
    return own


def convert(spark: SparkSession, source: str, destination: str, revision: str = LOCAL, with_conllu: bool = False, summary: str | None = None) -> dict:
    """Read, check, relate, build and write. Nothing is written if a rule is broken."""
    valid_revision(revision)
    summary, took, began = summary_path(summary, destination), {}, time.time()

    def phase(name: str) -> None:
        nonlocal began
        took[name] = round(time.time() - began, 3)
        began = time.time()

    records = read_records(spark, source)
    bad = layout_violations(spark, source).union(record_violations(records)).take(1)
    if bad:
        raise IntegrityError(f"{bad[0]['rule']}: {bad[0]['key']}")
    corpus = parse_records(records).strict()
    phase("parse")
    ledger = None
    if with_conllu:
        corpus.words, rows = supplement(corpus, read_records(spark, source, "CONLLU", ".conllu"))
        ledger = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        phase("supplement")
    lost = unresolved_witnesses(corpus).take(1)
    if lost:
        raise IntegrityError(f"unresolved witness {lost[0]['target_id']}")
    graph = build_graph(corpus, derive_relations(corpus))
    phase("graph")
    write_graph(graph, destination)
    phase("write")
    result = {
        "revision": revision, "seconds": took, "tables": {r["table"]: r["n"] for r in corpus_census(corpus).collect()}, "edges": {r["kind"]: r["count"] for r in graph.edges.groupBy("kind").count().collect()},
        "conllu": ledger, "without_license": missing_metadata(corpus).agg(F.count("*")).collect()[0][0], "fingerprint": digest(graph).collect()[0][0],
    }
    if summary:
        with open(f"{summary}.part", "x") as f:
            json.dump(result, f, indent=1, sort_keys=True)
        os.rename(f"{summary}.part", summary)
    return result


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("--revision", default=LOCAL)
    p.add_argument("--conllu", action="store_true")
    p.add_argument("--summary")
    a = p.parse_args(args)
    print(json.dumps(convert(SparkSession.builder.getOrCreate(), a.source, a.destination, a.revision, a.conllu, a.summary), sort_keys=True))


if __name__ == "__main__":
    main()
