"""The service as a FastAPI application, where that library is installed."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from causeway import api

ROUTES = [("GET", "/api/evidence"), ("POST", "/api/run"), ("POST", "/api/loss")]
HOME = "<!doctype html><title>Causeway</title><h1>Causeway</h1><ul>" + "".join(f"<li><code>{m} {p}</code></li>" for m, p in ROUTES) + "</ul>"


def create_app(spark: SparkSession, folder: str = "."):
    """The same answers as ``api.serve``, and a page that names them; for any ASGI server."""
    try:
        from fastapi import FastAPI, HTTPException
        from fastapi.responses import HTMLResponse
    except ImportError as e:
        raise ImportError("create_app needs fastapi; api.serve does without") from e

    app = FastAPI(title="Causeway")

    @app.get("/", include_in_schema=False)
    def home():
        return HTMLResponse(HOME)

    def answered(method: str, path: str, payload: dict | None = None) -> dict:
        status, out = api.answer(spark, method, path, json.dumps(payload or {}), folder)
        if status != 200:
            raise HTTPException(status_code=status, detail=out["error"])
        return out

    @app.get("/api/evidence")
    def evidence() -> dict:
        return answered("GET", "/api/evidence")

    @app.post("/api/run")
    def run(payload: dict | None = None) -> dict:
        return answered("POST", "/api/run", payload)

    @app.post("/api/loss")
    def loss(payload: dict | None = None) -> dict:
        return answered("POST", "/api/loss", payload)

    return app
