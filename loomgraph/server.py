"""Tools over a graph for assistants: JSON-RPC requests, a line each on standard input, or posted over HTTP.

The graph is loaded again when a newer version was written. Answers are text of a bounded size.
"""

from __future__ import annotations

import hmac
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import analysis, feedback, resolve, traversal
from loomgraph.sources import files, report

VERSION = "2024-11-05"
#: Rows of an answer.
MOST = 200


def _lines(df: DataFrame, most: int = MOST) -> str:
    return "\n".join("  ".join("" if v is None else str(v) for v in r) for r in df.limit(most).collect()) or "nothing"


class Tools:
    """The tools and resources of one graph. ``load()`` gives nodes, edges and communities; ``prs`` a table ``(number, title, base, ci, review, draft, days_old, path)``."""

    def __init__(self, spark: SparkSession, load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], memories: str | None = None, prs: DataFrame | None = None, base: str = "main"):
        self.spark, self.load, self.memories, self.prs, self.base = spark, load, memories, prs, base
        text, number = {"type": "string"}, {"type": "integer"}
        self.tools: dict[str, tuple[str, dict, list[str], Callable[..., str]]] = {
            "query_graph": ("Ask a question; the surroundings of what matches best.", {"question": text, "depth": number, "token_budget": number}, ["question"], self.query_graph),
            "get_node": ("A node by id or name.", {"label": text}, ["label"], self.get_node),
            "get_neighbors": ("A node's edges, those whose relation holds a text.", {"label": text, "relation_filter": text}, ["label"], self.get_neighbors),
            "get_community": ("Members of a community.", {"community_id": number}, ["community_id"], self.get_community),
            "god_nodes": ("The best-connected entities.", {"top_n": number, "by": text}, [], self.god_nodes),
            "graph_stats": ("Counts of nodes, edges, communities and certainty.", {}, [], self.graph_stats),
            "dead_code": ("Functions no call reaches.", {"top_n": number}, [], self.dead_code),
            "blast_radius": ("What a change of a node reaches.", {"label": text, "max_hops": number, "direction": text}, ["label"], self.blast_radius),
            "shortest_path": ("A path between two names.", {"source": text, "target": text, "source_path": text, "target_path": text}, ["source", "target"], self.shortest_path),
            "save_result": ("Keep an answer and the nodes it rests on.", {"question": text, "answer": text, "nodes": {"type": "array", "items": text}, "outcome": text, "correction": text}, ["question", "answer"], self.save_result),
            "list_prs": ("Open pull requests by what has to be done.", {}, [], self.list_prs),
            "get_pr_impact": ("Communities and nodes that a pull request touches.", {"number": number}, ["number"], self.get_pr_impact),
            "triage_prs": ("Pull requests in the order to review them, with their reach.", {}, [], self.triage_prs),
        }
        self.resources: dict[str, Callable[[], str]] = {
            "report": lambda: report.markdown(*self._with_community()), "stats": self.graph_stats, "god-nodes": self.god_nodes, "audit": lambda: _lines(analysis.confidence_breakdown(self.load()[1]).orderBy("confidence")),
            "surprises": lambda: _lines(analysis.surprising(*self.load(), top=10)), "questions": lambda: _lines(analysis.questions(*self.load(), top=10)),
        }

    def _with_community(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        n, e, c = self.load()
        return n.drop("community").join(c, "id", "left"), e, c

    def _one(self, nodes: DataFrame, label: str) -> DataFrame:
        found = resolve.resolve_seed(nodes, label).select("id")
        if found.isEmpty():
            raise ValueError(f"no single node is called {label!r}")
        return found

    def query_graph(self, question: str, depth: int = 3, token_budget: int = 2000) -> str:
        n, e, _ = self.load()
        return report.answer(n, e, question, min(int(depth), 6), min(int(token_budget), 20_000)) or "no node matches"

    def get_node(self, label: str) -> str:
        n, e, _ = self.load()
        one = self._one(n, label)
        return _lines(n.join(one, "id", "left_semi").join(traversal.degrees(e), "id", "left"))

    def get_neighbors(self, label: str, relation_filter: str = "") -> str:
        n, e, _ = self.load()
        return _lines(traversal.neighbors(e, n, self._one(n, label).first()["id"], relation_filter).orderBy("direction", "relation", "id"))

    def get_community(self, community_id: int) -> str:
        n, e, c = self.load()
        members = c.where(F.col("community") == int(community_id)).join(n.select("id", "label", "source_file"), "id").join(traversal.degrees(e), "id", "left")
        return _lines(members.orderBy(F.desc("degree"), "id").select("label", "source_file", "degree"))

    def god_nodes(self, top_n: int = 10, by: str = "degree") -> str:
        n, e, _ = self.load()
        if by not in ("degree", "pagerank"):
            raise ValueError("by is degree or pagerank")
        ranks = traversal.pagerank(n, e.withColumn("weight", F.lit(1.0))) if by == "pagerank" else None
        return _lines(analysis.god_nodes(n, e, int(top_n), ranks))

    def graph_stats(self) -> str:
        n, e, _ = self._with_community()
        row = analysis.graph_stats(n, e).first().asDict()
        return "\n".join(f"{k}: {v}" for k, v in row.items())

    def dead_code(self, top_n: int = 15) -> str:
        n, e, _ = self.load()
        return _lines(traversal.unreachable_functions(n, e).orderBy("label", "id"), int(top_n))

    def blast_radius(self, label: str, max_hops: int = 2, direction: str = "callers") -> str:
        n, e, _ = self.load()
        return _lines(traversal.blast_radius(e, self._one(n, label), min(int(max_hops), 6), direction).join(n.select("id", "label"), "id").orderBy("hop", "id"))

    def shortest_path(self, source: str, target: str, source_path: str = "", target_path: str = "") -> str:
        n, e, _ = self.load()
        found = traversal.find_path(n, e, source, target, source_path, target_path)
        if "error" in found:
            return found["error"]
        return "\n".join([*found["warnings"], " -> ".join(found["path"]) if found["path"] else "no path", *(["through well-connected nodes, as there is no other way"] if found["used_noise"] else [])])

    def save_result(self, question: str, answer: str, nodes: list[str] | None = None, outcome: str | None = None, correction: str | None = None) -> str:
        if not self.memories:
            raise ValueError("no folder for records was named")
        if outcome not in (None, "useful", "dead_end", "corrected"):
            raise ValueError("outcome is useful, dead_end or corrected")
        files.save_memory(self.spark, self.memories, question, answer, list(nodes or []), outcome, correction)
        return "saved"

    def lessons(self) -> str:
        """What the records say of the nodes they cite."""
        scores = feedback.node_scores(files.read_memories(self.spark, self.memories), F.current_timestamp())
        return _lines(feedback.verdicts(scores).orderBy("status", F.desc("score"), "node"))

    def _prs(self) -> DataFrame:
        if self.prs is None:
            raise ValueError("no table of pull requests was named")
        from loomgraph.functions import rules

        status = rules.pr_status(F.col("base"), F.col("ci"), F.col("review"), F.col("draft"), F.col("days_old"), self.base)
        once = self.prs.drop("path").distinct().withColumn("status", status)
        return analysis.pr_order(once)

    def list_prs(self) -> str:
        return _lines(self._prs().orderBy("place").select("number", "status", "ci", "days_old", "title"))

    def _impact(self) -> DataFrame:
        n, _, _ = self._with_community()
        return resolve.pr_impact(n, self.prs.select(F.col("number").alias("pr"), "path"))

    def get_pr_impact(self, number: int) -> str:
        self._prs()
        return _lines(self._impact().where(F.col("pr") == int(number)))

    def triage_prs(self) -> str:
        own = self._prs().where("status <> 'WRONG-BASE'")
        return _lines(own.join(self._impact().withColumnRenamed("pr", "number"), "number", "left").orderBy("place").select("number", "status", "ci", "days_old", "n_nodes", "communities", "title"))

    def handle(self, request: dict[str, Any]) -> dict[str, Any] | None:
        """The answer to one request; None to a notification."""
        method, params, number = request.get("method"), request.get("params") or {}, request.get("id")
        if number is None:
            return None
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": number}
        try:
            if method == "initialize":
                answer["result"] = {"protocolVersion": VERSION, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "loomgraph", "version": "2"}}
            elif method == "ping":
                answer["result"] = {}
            elif method == "tools/list":
                answer["result"] = {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for k, (d, p, r, _) in self.tools.items()]}
            elif method == "tools/call":
                if params.get("name") not in self.tools:
                    raise LookupError(f"no tool {params.get('name')!r}")
                try:
                    answer["result"] = {"content": [{"type": "text", "text": self.tools[params["name"]][3](**(params.get("arguments") or {}))}]}
                except (ValueError, TypeError, KeyError) as e:
                    answer["result"] = {"content": [{"type": "text", "text": str(e)}], "isError": True}
            elif method == "resources/list":
                answer["result"] = {"resources": [{"uri": f"graph://{k}", "name": k, "mimeType": "text/plain"} for k in self.resources]}
            elif method == "resources/read":
                name = str(params.get("uri", "")).removeprefix("graph://")
                if name not in self.resources:
                    raise LookupError(f"no resource {name!r}")
                answer["result"] = {"contents": [{"uri": f"graph://{name}", "mimeType": "text/plain", "text": self.resources[name]()}]}
            else:
                raise LookupError(f"no method {method!r}")
        except LookupError as e:
            answer["error"] = {"code": -32601, "message": str(e.args[0])}
        return answer


def serve_lines(tools: Tools, source: TextIO | None = None, sink: TextIO | None = None) -> None:
    """A request a line until the input ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            answer = tools.handle(json.loads(line))
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            sink.write(json.dumps(answer) + "\n")
            sink.flush()


def http_server(tools: Tools, host: str = "127.0.0.1", port: int = 8080, key: str | None = None, path: str = "/mcp") -> ThreadingHTTPServer:
    """A server of posted requests; with a key only for those who bear it. Call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            if self.path != path:
                return self.send_error(404)
            if key and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {key}"):
                return self.send_error(401)
            try:
                answer = tools.handle(json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))))
            except ValueError:
                return self.send_error(400)
            body = json.dumps(answer).encode() if answer is not None else b""
            self.send_response(200 if body else 202)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            """Requests aren't logged here; see ``files.log_query``."""

    return ThreadingHTTPServer((host, port), Handler)
