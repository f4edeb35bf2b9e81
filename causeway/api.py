"""The service: evidence, paired runs and set losses, over HTTP with the standard library.

``GET /api/evidence``, ``POST /api/run``, ``POST /api/loss``; a bad request is answered
with status 400 and a message.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from pyspark.sql import SparkSession

from causeway.plans import experiments
from causeway.sources.files import evidence

_lock = Lock()


def answer(spark: SparkSession, method: str, path: str, body: bytes | str | None = None, folder: str = ".") -> tuple[int, dict]:
    """Status and payload; runs go one at a time, so that equal requests meet the cache."""
    try:
        settings = json.loads(body) if body else {}
        if not isinstance(settings, dict):
            raise ValueError("a JSON object is asked for")
        if (method, path) == ("GET", "/api/evidence"):
            return 200, evidence(spark, folder)
        with _lock:
            if (method, path) == ("POST", "/api/run"):
                return 200, experiments.run_experiment(spark, settings)
            if (method, path) == ("POST", "/api/loss"):
                return 200, experiments.run_loss(settings)
    except ValueError as e:
        return 400, {"ok": False, "error": str(e)}
    return 404, {"ok": False, "error": f"no {method} {path}"}


def serve(spark: SparkSession, port: int = 8000, folder: str = ".") -> ThreadingHTTPServer:
    """A server that is bound and waits for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            status, payload = answer(spark, self.command, self.path, self.rfile.read(n) if n else None, folder)
            raw = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
