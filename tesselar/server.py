"""A small HTTP server over a long-lived engine: /, /api/meta and /api/search."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from tesselar.operators.rerank import make_reranker
from tesselar.operators.search import Engine

HOST, PORT = "127.0.0.1", 8105
_PAGE = """<!doctype html><meta charset=utf-8><title>Search</title><form action=/api/search><input name=q autofocus> <button>Search</button></form>"""


def present(row) -> dict:
    """A hit for people: scores to five places, its parts to four, contributions of terms to three."""
    r = row.asDict(recursive=True)
    r["score"] = round(r["score"], 5)
    for k in ("bm25", "vector", "fused", "reranked"):
        r[k] = None if r[k] is None else round(r[k], 4)
    r["parts"] = {k: round(v, 4) for k, v in (r["parts"] or {}).items()}
    r["terms"] = [[t["term"], round(t["contrib"], 3)] for t in r.get("terms") or []]
    return r


def search_one(engine: Engine, text: str, **how) -> list[dict]:
    spark = engine.chunks.sparkSession
    hits = engine.search(spark.createDataFrame([(0, text)], "qid long, text string"), **how)
    return [present(r) for r in hits.orderBy("rank").collect()]


def make_server(engine: Engine, host: str = HOST, port: int = PORT) -> ThreadingHTTPServer:
    meta = {"documents": engine.chunks.select("doc").distinct().count(), "chunks": engine.chunks.count(), "embedder": engine.embedder.name if engine.embedder else None, "graph": engine.graph is not None}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body, kind: str = "application/json") -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            for name, value in (("Content-Length", len(data)), ("Content-Type", f"{kind}; charset=utf-8")):
                self.send_header(name, str(value))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/":
                return self._send(200, _PAGE, "text/html")
            if url.path == "/api/meta":
                return self._send(200, meta)
            if url.path != "/api/search":
                return self._send(404, {"error": "not found"})
            text = asked.get("q", "").strip()
            if not text:
                return self._send(400, {"error": "q is empty"})
            try:
                reranker = make_reranker(asked.get("rerank", "none"), terms=engine.index.terms())
                hits = search_one(engine, text, k=int(asked.get("k", 10)), mode=asked.get("mode", "rrf" if engine.vectors is not None else "bm25"), alpha=float(asked.get("alpha", 0.35)), reranker=reranker)
                return self._send(200, {"query": text, "hits": hits})
            except Exception as e:
                return self._send(200, {"error": str(e)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str = HOST, port: int = PORT) -> None:
    """Serve until interrupted."""
    server = make_server(engine, host, port)
    try:
        server.serve_forever()
    finally:
        server.server_close()


def serve_in_background(engine: Engine) -> ThreadingHTTPServer:
    """A server on a free port, for tests."""
    server = make_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
