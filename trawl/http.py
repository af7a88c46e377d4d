"""The HTTP surface, on the standard library: /search /ask /investigate /link /entity/{id} /health /metrics."""

from __future__ import annotations

import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from trawl.operators import graph
from trawl.plans import agent, answer
from trawl.plans.observability import REGISTRY, Timed, begin_request, log, log_as_json


#: Most neighbours that a page shows; a hub may have millions.
NEIGHBOURS = 1_000


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def _number(given: dict, name: str, default: int, least: int, most: int) -> int:
    try:
        value = int(given.get(name, default))
    except (TypeError, ValueError):
        raise Refused(422, f"{name} must be a number") from None
    if not least <= value <= most:
        raise Refused(422, f"{name} must lie between {least} and {most}")
    return value


def _text(given: dict, name: str, least: int, most: int = 10_000) -> str:
    value = given.get(name)
    if not isinstance(value, str) or not least <= len(value) <= most:
        raise Refused(422, f"{name} must have {least} to {most} characters")
    return value


def _flag(given: dict, name: str, default: bool) -> bool:
    value = given.get(name, default)
    return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")


def respond(pipeline, method: str, path: str, given: dict):
    """The answer to one request, as JSON values (or text for /metrics). Raises ``Refused``."""
    if (method, path) == ("GET", "/metrics"):
        return REGISTRY.exposition()
    if (method, path) == ("GET", "/health"):
        return {"status": "ok", "entities": pipeline.entities.count(), "relations": pipeline.relations.count()}
    if (method, path) == ("GET", "/search"):
        q, k = _text(given, "q", 2), _number(given, "k", 10, 1, 50)
        with Timed("retrieve", query_len=len(q), k=k) as timed:
            rows = pipeline.hits(pipeline.search(q, k, expand=_flag(given, "expand", False))).collect()
            timed.results = len(rows)
        return [{c: r[c] for c in ("id", "caption", "schema", "countries", "topics", "datasets", "score")} for r in rows]
    if (method, path) == ("POST", "/ask"):
        question, k = _text(given, "question", 3, 500), _number(given, "k", 8, 1, 50)
        asked = pipeline.queries(question)
        run = pipeline.search(asked, k, expand=_flag(given, "expand", True))
        text = answer.answer(asked, run, pipeline.entities, k).first()
        rows = answer.gather(run, pipeline.entities, k).orderBy("rank").collect()
        return {"question": question, "answer": text.text, "generator": text.generator, "evidence": [{"id": r.doc_id, "caption": r.caption, "datasets": r.datasets} for r in rows]}
    if (method, path) == ("POST", "/investigate"):
        if given.get("engine", "rules") != "rules":
            raise Refused(422, "engine must be rules")
        return agent.investigate(pipeline, _text(given, "question", 3, 500), _number(given, "max_iterations", 3, 1, 6), _number(given, "k", 8, 1, 50), _flag(given, "expand", True))
    if (method, path) == ("GET", "/link"):
        found = agent.link(pipeline, _text(given, "a", 2), _text(given, "b", 2), _number(given, "hops", 3, 0, 10))
        if not found["found"] and found["reason"].endswith("not found"):
            raise Refused(404, found["reason"])
        return found
    if method == "GET" and (one := re.fullmatch("/entity/([^/]+)", path)):
        e = pipeline.get(unquote(one[1]))
        if e is None:
            raise Refused(404, "unknown entity")
        most = _number(given, "neighbours", NEIGHBOURS, 1, NEIGHBOURS)
        near = graph.view(pipeline.entities.where(F.col("id") == e.id).select("id"), pipeline.relations, pipeline.entities, most).collect()
        fields = {c: e[c] for c in ("id", "caption", "schema", "countries", "topics", "datasets", "properties")}
        return fields | {"neighbours": [{"id": n.neighbour, "caption": n.caption, "relation": n.relation, "direction": n.direction} for n in near]}
    raise Refused(404, "no such page")


def handler(pipeline) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _serve(self, given: dict) -> None:
            rid, began, path = begin_request(), time.perf_counter(), urlsplit(self.path).path
            try:
                status, body = 200, respond(pipeline, self.command, path, given)
            except Refused as e:
                status, body = e.status, {"detail": e.detail}
            took = time.perf_counter() - began
            page = "/" + path.split("/")[1]  # ids would make a sample each
            REGISTRY.time("http_request", took, page=page)
            REGISTRY.count("http_request", method=self.command, page=page, status=str(status))
            log.info("request", extra={"method": self.command, "path": path, "status": status, "duration_ms": round(1000 * took, 2)})
            data = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("content-type", "text/plain; version=0.0.4" if isinstance(body, str) else "application/json")
            self.send_header("content-length", str(len(data)))
            self.send_header("x-request-id", rid)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._serve({k: v[-1] for k, v in parse_qs(urlsplit(self.path).query).items()})

        def do_POST(self) -> None:
            try:
                given = json.loads(self.rfile.read(int(self.headers.get("content-length", 0))) or "{}")
            except ValueError:
                given = {}
            self._serve(given if isinstance(given, dict) else {})

        def log_message(self, *_) -> None:
            pass

    return Handler


def serve(pipeline, port: int = 8000) -> None:
    log_as_json()
    ThreadingHTTPServer(("", port), handler(pipeline)).serve_forever()
