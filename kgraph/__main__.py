"""Command line: validate a graph, compare two, export the schema, or serve the tools.

Exit codes: 0 if all is well, 1 if there are findings that are errors (validate), 2 if the input can't be read.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from kgraph import schema as S
from kgraph.operators import curate, evaluate, validate
from kgraph.operators.graph import Graph
from kgraph.plans.server import Tools, serve_lines
from kgraph.sources import documents as docs

THRESHOLDS = [0.3, 0.5, 0.7, 0.9]


def _graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*docs.read_graph(spark, path))


def compared(a: Graph, b: Graph) -> str:
    """Two snapshots as text: ids and names in both, then the statements kept at each threshold."""
    lines = []
    for column in ("id", "name"):
        r = evaluate.overlap(a.topics, b.topics, column).first()
        lines.append(f"{column}: {r['both']} of {r['either']} in both, {r['jaccard']:.2f}")
    for r in curate.retention(a.topics, b.topics, THRESHOLDS).orderBy("threshold").collect():
        share = r["matched"] / r["statements"] if r["statements"] else 0.0
        lines.append(f"at {r['threshold']}: {r['matched']} of {r['statements']} statements kept ({share:.2f}), {r['verbatim']} verbatim, {r['lost']} lost, {r['added']} added, median {r['median_score']:.2f}; {r['hollowed']} topics hollowed, {r['renamed']} renamed")
    return "\n".join(lines) + "\n"


def run(argv: list[str], spark: SparkSession | None = None, source=None, sink=None) -> int:
    p = argparse.ArgumentParser(prog="kgraph")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("validate").add_argument("graph")
    c = sub.add_parser("compare")
    c.add_argument("earlier")
    c.add_argument("later")
    sub.add_parser("schema").add_argument("out")
    sub.add_parser("serve").add_argument("graph", nargs="?", default=os.environ.get("KGRAPH_PATH"))
    a = p.parse_args(argv)
    sink = sink or sys.stdout
    if a.what == "schema":
        docs.write_json_schema(a.out)
        return 0
    spark = spark or SparkSession.builder.appName("kgraph").getOrCreate()
    try:
        if a.what == "compare":
            sink.write(compared(_graph(spark, a.earlier), _graph(spark, a.later)))
            return 0
        if not a.graph:
            raise ValueError("no graph was named, neither as an argument nor in KGRAPH_PATH")
        g = _graph(spark, a.graph)
    except Exception as e:  # noqa: BLE001 -- whatever keeps the input from being read
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    if a.what == "serve":
        serve_lines(Tools(g), source or sys.stdin, sink)
        return 0
    text, code = docs.report(validate.summarised(validate.run_all(g)))
    sink.write(text)
    return code


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
