"""A browser viewer: a page, and JSON of windows of a table, over HTTP.

``/`` the page; ``/api/meta`` columns and row count; ``/api/version``; ``/api/rows?startRow&endRow[&groupBy=book]``
at most ``MAX_ROWS`` rows a request; ``/stream`` server-sent events, one for each new version.
"""

from __future__ import annotations

import json
import queue
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from . import grid
from .sources.wide_book import BOOKS, WideBookTable
from .tables import Slice, Table
from .viewport import ALL, RowRange, Viewport

MAX_ROWS = 2000

_PAGE = """<!doctype html><meta charset="utf-8"><title>viewlark</title>
<style>body{font:13px sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style>
<p><button id=back>&larr;</button> <span id=at></span> <button id=on>&rarr;</button></p><table id=t></table>
<script>
let start = 0, step = 200, last = 0;
async function draw() {
  const meta = await (await fetch('/api/meta')).json();
  const got = await (await fetch(`/api/rows?startRow=${start}&endRow=${start + step}`)).json();
  last = got.lastRow;
  const t = document.getElementById('t'), row = t.createTHead(); t.innerHTML = '';
  const add = (tag, values) => { const r = t.insertRow(); for (const v of values) { const c = document.createElement(tag); c.textContent = v === null ? '' : v; r.append(c); } };
  add('th', meta.columnDefs.map(c => c.headerName));
  for (const r of got.rows || []) add('td', meta.columnDefs.map(c => r[c.field]));
  document.getElementById('at').textContent = `${start} of ${last}, version ${got.version}`;
}
document.getElementById('back').onclick = () => { start = Math.max(0, start - step); draw(); };
document.getElementById('on').onclick = () => { if (start + step < last) start += step; draw(); };
new EventSource('/stream').onmessage = draw; draw();
</script>"""


class Server:
    def __init__(self, table: Table, viewport: Viewport, port: int, host: str):
        self.table, self.viewport = table, viewport
        self._waiting: list[queue.Queue] = []
        viewer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                viewer._get(self)

            def log_message(self, *_: object) -> None:
                pass

        self._http = ThreadingHTTPServer((host, port), Handler)
        self._http.daemon_threads = True
        self.url = f"http://{host}:{self._http.server_address[1]}"
        for t in table.base_tables():
            if hasattr(t, "add_listener"):
                t.add_listener(self._changed)
        threading.Thread(target=self._http.serve_forever, daemon=True).start()

    def _changed(self, _: int) -> None:
        for q in list(self._waiting):
            q.put(self.table.version)

    def close(self) -> None:
        for t in self.table.base_tables():
            if hasattr(t, "remove_listener"):
                t.remove_listener(self._changed)
        self._http.shutdown()
        self._http.server_close()

    def _get(self, h: BaseHTTPRequestHandler) -> None:
        url = urlparse(h.path)
        if url.path == "/":
            _send(h, 200, _PAGE, "text/html")
        elif url.path == "/api/meta":
            _send(h, 200, grid.meta_json(self.table.schema, self.table.size))
        elif url.path == "/api/version":
            _send(h, 200, json.dumps({"version": self.table.version}))
        elif url.path == "/api/rows":
            _send(h, *self.rows({k: v[0] for k, v in parse_qs(url.query).items()}))
        elif url.path == "/stream":
            self._stream(h)
        else:
            _send(h, 404, json.dumps({"error": "no such page"}))

    def rows(self, asked: dict[str, str]) -> tuple[int, str]:
        by_book = asked.get("groupBy", "").strip().lower() == "book" and isinstance(self.table, WideBookTable)
        last = BOOKS if by_book else self.table.size
        start = max(0, _number(asked.get("startRow"), 0))
        if start >= last:
            schema = self.table.aggregate_schema if by_book else self.table.schema
            spark = self.table.base_tables()[0].spark
            return 200, grid.infinite_block(Slice.empty(spark, schema, self.table.version), last)
        end = _number(asked.get("endRow"), start + min(MAX_ROWS, last - start))
        if end <= start:
            return 400, json.dumps({"error": "an empty block: endRow has to lie behind startRow"})
        rows = RowRange.of(start, min(end, start + MAX_ROWS)).intersect(RowRange.head(last)).intersect(self.viewport.rows)
        own = Viewport(rows, self.viewport.columns, self.viewport.order, self.viewport.limit)
        return 200, grid.infinite_block(self.table.read_aggregated_by_book(own) if by_book else self.table.read(own), last)

    def _stream(self, h: BaseHTTPRequestHandler) -> None:
        own: queue.Queue = queue.Queue()
        self._waiting.append(own)
        h.send_response(200)
        h.send_header("Content-Type", "text/event-stream")
        h.end_headers()
        try:
            version = self.table.version
            while True:
                h.wfile.write(f"data: {json.dumps({'kind': 'invalidate', 'version': version})}\n\n".encode())
                h.wfile.flush()
                version = own.get()
        except OSError:  # the browser has gone
            pass
        finally:
            self._waiting.remove(own)


def _number(text: str | None, otherwise: int) -> int:
    try:
        return int(text) if text else otherwise
    except ValueError:
        return otherwise


def _send(h: BaseHTTPRequestHandler, status: int, body: str, kind: str = "application/json") -> None:
    raw = body.encode()
    h.send_response(status)
    h.send_header("Content-Type", f"{kind}; charset=utf-8")
    h.send_header("Content-Length", str(len(raw)))
    h.end_headers()
    h.wfile.write(raw)


def serve(table: Table, viewport: Viewport = ALL, port: int = 0, host: str = "127.0.0.1") -> Server:
    return Server(table, viewport, port, host)
