"""The six tools over one graph, by name with plain arguments and plain results, and a server of them over lines of text."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable

from kgraph.operators import serve
from kgraph.operators.graph import Graph, plan_path, prerequisites


class Tools:
    def __init__(self, graph: Graph):
        self.graph = graph

    def search_topics(self, query: str, grade: int | None = None, limit: int = 5) -> list[dict]:
        return [r.asDict(True) for r in serve.search_topics(self.graph, query, grade, limit).collect()]

    def match_misconceptions(self, observation: str, limit: int = 5) -> list[dict]:
        return [r.asDict(True) for r in serve.match_misconceptions(self.graph, observation, limit).collect()]

    def get_topic(self, topic_id: str) -> dict:
        return serve.get_topic(self.graph, topic_id).first().asDict(True)

    def get_prerequisites(self, topic_id: str, depth: int = 2, include_soft: bool = True) -> list[dict]:
        self.graph.require([topic_id])
        start = self.graph.topics.sparkSession.createDataFrame([(topic_id,)], "id string")
        return [r.asDict(True) for r in prerequisites(self.graph, start, depth, include_soft).orderBy("level", "id").collect()]

    def plan_path(self, target: str, known_ids: list[str] | None = None, include_soft: bool = True) -> dict:
        steps, skipped, cyclic = plan_path(self.graph, target, known_ids, include_soft)
        return {"steps": [r.asDict(True) for r in steps.collect()], "skipped_known": skipped, "has_cycle": cyclic}

    def get_graph_stats(self) -> dict:
        t = self.graph.topics
        out = serve.graph_counts(self.graph).first().asDict()
        out["grade_distribution"] = {r["grade"]: r["topics"] for r in serve.grade_distribution(t).orderBy("grade").collect()}
        out["review_status_counts"] = {r["review_status"]: r["topics"] for r in serve.review_status_counts(t).collect()}
        return out


NAMES = ("search_topics", "match_misconceptions", "get_topic", "get_prerequisites", "plan_path", "get_graph_stats")


def answer(tools: Tools, request: dict) -> dict | None:
    """One request of JSON-RPC 2.0 with the methods initialize, tools/list and tools/call; None for a notification."""
    method, params, rid = request.get("method"), request.get("params") or {}, request.get("id")
    if rid is None:
        return None
    reply = {"jsonrpc": "2.0", "id": rid}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "kgraph", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": n.replace("_", " "), "inputSchema": _inputs(getattr(tools, n))} for n in NAMES]}}
    if method != "tools/call" or params.get("name") not in NAMES:
        return reply | {"error": {"code": -32601, "message": f"unknown: {params.get('name', method)}"}}
    try:
        got = getattr(tools, params["name"])(**params.get("arguments") or {})
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}], "isError": False}}
    except (ValueError, TypeError) as e:  # unknown ids, negative limits, wrong arguments: the caller's to mend
        return reply | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}


def _inputs(tool) -> dict:
    kinds = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}
    given = inspect.signature(tool).parameters
    fields = {n: {"type": kinds.get(str(p.annotation).split(" |")[0], "string")} for n, p in given.items()}
    return {"type": "object", "properties": fields, "required": [n for n, p in given.items() if p.default is p.empty]}


def serve_lines(tools: Tools, source: Iterable[str], sink) -> None:
    """Answer requests, one a line, until the source ends: standard input and output, or any other pair."""
    for line in source:
        if not line.strip():
            continue
        try:
            out = answer(tools, json.loads(line))
        except json.JSONDecodeError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
