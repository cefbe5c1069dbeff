"""A SPARQL endpoint: GET and POST queries, gated updates, health and metrics."""

from __future__ import annotations

import argparse
import hmac
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .errors import EngineError, ParseError
from .metrics import METRICS
from .sources import writers


class Endpoint:
    """``engine`` answers queries; ``store``, if given and updates are allowed, takes updates."""

    def __init__(self, engine, store=None, allow_updates: bool = False, auth_token: str | None = None, cors_origin: str | None = None, timeout: float = 60.0):
        self.engine, self.store, self.timeout = engine, store, timeout
        self.allow_updates, self.auth_token, self.cors_origin = allow_updates, auth_token, cors_origin

    def current(self):
        return self.store.engine() if self.store is not None else self.engine

    def query(self, text: str, accept: str | None) -> tuple[int, str, str]:
        engine = self.current()
        result = engine.query(text)
        table = {"select": writers.SELECT, "ask": writers.ASK}.get(result.form, writers.GRAPH)
        kind = writers.negotiate(accept, list(table))
        if kind is None:
            return 406, "text/plain", "none of the accepted types is offered"

        def run() -> str:
            if result.form == "ask":
                return "".join(table[kind](result.native().first()["ask"]))
            return "".join(table[kind](result.terms()))

        return 200, kind, engine.with_timeout(run, self.timeout)

    def update(self, text: str, authorization: str | None) -> tuple[int, str, str]:
        if not self.allow_updates or self.store is None:
            return 403, "text/plain", "updates are not allowed"
        if self.auth_token and not hmac.compare_digest((authorization or "").encode(), f"Bearer {self.auth_token}".encode()):
            return 401, "text/plain", "a bearer token is needed"
        self.store.update(text)
        return 204, "text/plain", ""


def handler(endpoint: Endpoint) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, kind: str, body: str) -> None:
            data = body.encode("utf-8", "replace")
            self.send_response(status)
            if endpoint.cors_origin:
                self.send_header("Access-Control-Allow-Origin", endpoint.cors_origin)
                self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
                self.send_header("Access-Control-Allow-Headers", "Content-Type, Accept, Authorization")
            if status == 401:
                self.send_header("WWW-Authenticate", "Bearer")
            if status != 204:
                self.send_header("Content-Type", f"{kind}; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if status != 204:
                self.wfile.write(data)

        def guarded(self, f) -> None:
            with METRICS.connection():
                try:
                    self.reply(*f())
                except EngineError as e:
                    self.reply(e.status, "text/plain", str(e))
                except Exception as e:  # noqa: BLE001  an answer is owed whatever went wrong
                    self.reply(500, "text/plain", str(e).splitlines()[0] if str(e) else type(e).__name__)

        def do_OPTIONS(self) -> None:
            self.reply(204, "text/plain", "")

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                self.reply(200, "application/json", '{"status":"ok"}')
            elif url.path == "/metrics":
                self.reply(200, "text/plain", METRICS.text())
            elif url.path == "/":
                self.reply(200, "text/plain", "SPARQL endpoint at /sparql")
            elif url.path == "/sparql":
                text = parse_qs(url.query).get("query", [None])[0]
                self.guarded(lambda: endpoint.query(text, self.headers.get("Accept")) if text else (400, "text/plain", "no query"))
            else:
                self.reply(404, "text/plain", "no such page")

        def do_POST(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip().lower()
            accept, auth = self.headers.get("Accept"), self.headers.get("Authorization")
            if url.path not in ("/sparql", "/update"):
                self.reply(404, "text/plain", "no such page")
                return
            form = parse_qs(body) if kind == "application/x-www-form-urlencoded" else {}
            query = body if kind == "application/sparql-query" else form.get("query", [None])[0]
            update = body if kind == "application/sparql-update" else form.get("update", [None])[0]

            def act() -> tuple[int, str, str]:
                if update is not None:
                    return endpoint.update(update, auth)
                if query is None:
                    raise ParseError("neither a query nor an update")
                return endpoint.query(query, accept)

            self.guarded(act)

    return Handler


def serve(endpoint: Endpoint, host: str = "127.0.0.1", port: int = 7200) -> ThreadingHTTPServer:
    """A server that is bound but not running; call ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler(endpoint))


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .store import Store

    p = argparse.ArgumentParser(description="SPARQL endpoint over a quad store")
    p.add_argument("store", help="folder of the store's change log")
    p.add_argument("--port", type=int, default=7200)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--master", default=None, help="Spark master, if not configured otherwise")
    p.add_argument("--allow-updates", action="store_true")
    p.add_argument("--auth-token")
    p.add_argument("--cors-origin")
    p.add_argument("--timeout", type=float, default=60.0)
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("quadloom")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    store = Store(spark, a.store)
    serve(Endpoint(None, store, a.allow_updates, a.auth_token, a.cors_origin, a.timeout), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
