"""HTTP front end: GET answers queries, PUT appends records. Standard library only."""

from __future__ import annotations

import json
import math
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .operators.topk import Query, collect
from .plans.expression import parse
from .sources import ingest


class BadRequest(ValueError):
    """What the client sent cannot be read."""


def _number(params: dict, name: str, kind: type, default):
    if name not in params:
        return default
    try:
        return kind(params[name][0])
    except ValueError as e:
        raise BadRequest(f"{name}: {e}") from e


def answer(store, query_string: str) -> dict:
    """Result of GET /?score=...&offset=0&limit=10&minScore=..."""
    params = parse_qs(query_string)
    if "score" not in params:
        raise BadRequest("score is missing")
    try:
        source = json.loads(params["score"][0])
    except ValueError as e:
        raise BadRequest(f"score: {e}") from e
    offset, limit = _number(params, "offset", int, 0), _number(params, "limit", int, 10)
    floor = _number(params, "minScore", float, -math.inf)
    if offset < 0 or limit < 0 or math.isnan(floor):
        raise BadRequest("offset, limit and minScore must be sensible numbers")
    query = Query(parse(source), limit=limit, offset=offset, min_score=None if floor == -math.inf else floor)
    return collect(store.query(query))


def put(store, path: str, body: bytes) -> None:
    """PUT /<id> with a values map, or PUT / with an array of {"id", "values"}."""
    try:
        data = json.loads(body)
        ident = unquote(path.lstrip("/"))
        if ident:
            records = [(ident, dict(data.items()))]
        else:
            records = [({k.lower(): v for k, v in r.items()}["id"], {k.lower(): v for k, v in r.items()}["values"]) for r in data]
        frame = ingest.from_records(store.spark, records)
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        raise BadRequest(str(e)) from e
    store.bulk_index(frame)


def handler(store, read_only: bool = False) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, body: dict | None = None) -> None:
            data = json.dumps(body).encode() if body is not None else b""
            self.send_response(status)
            if data:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _guard(self, work) -> None:
            try:
                status, body = 200, work()
            except BadRequest as e:
                status, body = 400, {"error": str(e)}
            except Exception as e:  # the scorer or the store refused
                status, body = 500, {"error": str(e)}
            self._reply(status, body)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path != "/":
                self._reply(404)
                return
            self._guard(lambda: answer(store, url.query))

        def do_PUT(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if read_only:
                self._reply(404)
                return
            self._guard(lambda: put(store, urlsplit(self.path).path, body))

        def do_POST(self) -> None:
            self._reply(404)

        do_DELETE = do_HEAD = do_POST

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(store, host: str = "127.0.0.1", port: int = 0, read_only: bool = False) -> ThreadingHTTPServer:
    """A server bound to ``host``:``port`` (0: any free one); call serve_forever() on it."""
    return ThreadingHTTPServer((host, port), handler(store, read_only))
