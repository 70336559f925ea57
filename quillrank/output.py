"""Results for people and programs: tables, JSON, and the answers of a search service."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from .api import Retriever
from .errors import FeatureNotEnabled, InvalidParameter, QuillError, SerializationError


def as_table(ids: list[int], scores: list[float]) -> str:
    lines = [f"{'rank':>4}  {'doc_id':>10}  {'score':>12}"]
    return "\n".join(lines + [f"{i:>4}  {d:>10}  {s:>12.6f}" for i, (d, s) in enumerate(zip(ids, scores), 1)])


def as_json(query: str, ids: list[int], scores: list[float], seconds: float) -> str:
    rows = [{"rank": i, "doc_id": d, "score": round(s, 6)} for i, (d, s) in enumerate(zip(ids, scores), 1)]
    return json.dumps({"query": query, "results": rows, "count": len(rows), "latency_ms": round(1000 * seconds, 3)})


class Service:
    """(status, body) of requests, for any HTTP server to send. Bodies of more than ``max_body`` bytes are refused."""

    max_body = 1 << 20

    def __init__(self, retriever: Retriever, approximate: bool = False) -> None:
        """``approximate``: for searches that don't say."""
        self.retriever, self.approximate = retriever, approximate

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, str]:
        routes = {("POST", "/search"): self._search, ("POST", "/batch"): self._batch, ("GET", "/health"): self._health, ("GET", "/stats"): self._stats, ("POST", "/admin/reload"): self._reload}
        if (method, path) not in routes:
            return 404, json.dumps({"error": "no such route"})
        if len(body.encode()) > self.max_body:
            return 413, json.dumps({"error": "body too large"})
        try:
            asked = json.loads(body) if body else {}
            if not isinstance(asked, dict):
                raise InvalidParameter("the body must be an object")
            return routes[method, path](asked)
        except (InvalidParameter, ValueError, KeyError) as e:
            return 400, json.dumps({"error": str(e)})
        except FeatureNotEnabled as e:
            return 501, json.dumps({"error": str(e)})
        except QuillError as e:
            return 500, json.dumps({"error": str(e)})

    def _search(self, asked: dict) -> tuple[int, str]:
        text, k, approximate = asked["query"], int(asked.get("top_k", 10)), asked.get("approximate")
        began = time.perf_counter()
        ids, scores = self.retriever.search(text, k, self.approximate if approximate is None else bool(approximate))
        return 200, as_json(text, ids, scores, time.perf_counter() - began)

    def _batch(self, asked: dict) -> tuple[int, str]:
        texts, k = list(asked["queries"]), int(asked.get("top_k", 10))
        began = time.perf_counter()
        found = self.retriever.search_batch(texts, k)
        seconds = time.perf_counter() - began
        return 200, json.dumps({"results": [json.loads(as_json(t, *f, seconds / len(texts))) for t, f in zip(texts, found)], "total_latency_ms": round(1000 * seconds, 3)})

    def _health(self, _: dict) -> tuple[int, str]:
        return 200, json.dumps({"status": "ok"})

    def _stats(self, _: dict) -> tuple[int, str]:
        return 200, json.dumps(self.retriever.stats())

    def _reload(self, _: dict) -> tuple[int, str]:
        return 501, json.dumps({"error": "not implemented"})

    def tools(self) -> list[dict]:
        """Descriptions of what an agent can call through ``call``."""
        query = {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1, "default": 10}}, "required": ["query"]}
        return [{"name": "search", "description": "Documents that best match a text", "inputSchema": query}, {"name": "index_stats", "description": "Size and parameters of the index", "inputSchema": {"type": "object", "properties": {}}}]

    def call(self, name: str, arguments: dict) -> str:
        status, body = {"search": ("POST", "/search"), "index_stats": ("GET", "/stats")}.get(name, (None, None)), ""
        if status[0] is None:
            raise InvalidParameter(f"no tool {name!r}")
        _, body = self.handle(*status, json.dumps(arguments) if name == "search" else "")
        return body

    def message(self, line: str) -> str | None:
        """The answer to one JSON-RPC message of an agent, None where none is due."""
        try:
            asked = json.loads(line)
            number, method, given = asked.get("id"), asked.get("method"), asked.get("params") or {}
        except (ValueError, AttributeError):
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a JSON object"}})
        if number is None:
            return None
        try:
            if method == "initialize":
                out = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillrank", "version": "1"}}
            elif method == "tools/list":
                out = {"tools": self.tools()}
            elif method == "tools/call":
                out = {"content": [{"type": "text", "text": self.call(given.get("name"), given.get("arguments") or {})}]}
            elif method == "ping":
                out = {}
            else:
                return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method!r}"}})
        except QuillError as e:
            return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e)}})
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": out})


def percentile(values: list[float], p: float) -> float:
    """The value at place round(p / 100 * (n - 1)) of the order, 0 for none."""
    return sorted(values)[int(p / 100 * (len(values) - 1) + 0.5)] if values else 0.0


@dataclass
class Measured:
    """One corpus of a report: seconds of building, of a batch, and of single queries."""

    name: str
    n_docs: int
    n_queries: int
    index_seconds: float
    batch_seconds: float
    single_seconds: list[float] = field(default_factory=list)
    ndcg_at_10: float | None = None

    @property
    def queries_per_second(self) -> float:
        return self.n_queries / self.batch_seconds if self.batch_seconds else 0.0

    def latency(self, p: float) -> float:
        """Milliseconds of a single query."""
        return 1000 * percentile(self.single_seconds, p)


@dataclass
class Report:
    """Measurements with when and where they were made; goes to JSON and back, and to a table."""

    time: str
    system: str
    corpora: list[Measured]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Report:
        try:
            held = json.loads(text)
            return Report(held["time"], held["system"], [Measured(**x) for x in held["corpora"]])
        except (ValueError, KeyError, TypeError) as e:
            raise SerializationError(f"not a report: {e}") from None

    def __str__(self) -> str:
        lines = [f"{self.time}, {self.system}", f"{'corpus':<12}{'docs':>10}{'queries':>9}{'index s':>9}{'batch q/s':>11}{'p50 ms':>9}{'p95 ms':>9}{'p99 ms':>9}{'nDCG@10':>9}"]
        for m in self.corpora:
            gain = "-" if m.ndcg_at_10 is None else f"{m.ndcg_at_10:.4f}"
            lines.append(f"{m.name:<12}{m.n_docs:>10}{m.n_queries:>9}{m.index_seconds:>9.2f}{m.queries_per_second:>11.1f}{m.latency(50):>9.0f}{m.latency(95):>9.0f}{m.latency(99):>9.0f}{gain:>9}")
        return "\n".join(lines)
