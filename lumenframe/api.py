"""Serving: functions that give JSON-ready results, a small HTTP front, named tools and their line protocol."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from lumenframe.functions.crypto import decrypt_fields
from lumenframe.functions.timeparse import parse_natural_time
from lumenframe.operators import activity, frames, search


class Service:
    """Answers over one store; ``clock`` gives the time in epoch seconds."""

    def __init__(self, store, clock, config: dict | None = None):
        self.store, self.clock, self.config = store, clock, config or {}

    def _frames(self, start=None, end=None):
        found = self.store.frames(start, end)
        return decrypt_fields(found, self.store.key) if self.store.key else found

    @staticmethod
    def _rows(found) -> list[dict]:
        return [row.asDict(recursive=True) for row in found.collect()]  # a limited report

    def health(self) -> dict:
        return {"status": "ok"}

    def search(self, query: str, limit: int = 20) -> list[dict]:
        if self.store.key:
            return self._rows(search.substring_search(self._frames(), query, self.clock(), limit).drop("stage"))
        return self._rows(search.search(self._frames(), query, limit, index=self.store.search_index()).drop("rank"))

    def smart_search(self, query: str, limit: int = 20, project: str | None = None) -> list[dict]:
        return self._rows(search.smart_search(self._frames(), query, limit, project, index=self.store.search_index()))

    def recent(self, minutes: float = 30, limit: int = 50) -> list[dict]:
        now = self.clock()
        return self._rows(frames.recent(self._frames(now - 60.0 * minutes), now, minutes, limit))

    def latest(self) -> dict | None:
        return next(iter(self._rows(frames.latest(self._frames()))), None)

    def during(self, expression: str, limit: int = 100) -> list[dict]:
        start, end = parse_natural_time(expression, self.clock())
        return self._rows(frames.time_range(self._frames(start, end), start, end, limit))

    def focus(self, minutes: float = 60) -> dict:
        now = self.clock()
        window = self._frames(now - 60.0 * minutes)
        rows = self._rows(frames.focus_stats(window, now, minutes, self.config.get("capture_interval", 10)))
        switches = activity.context_switches(window.where(F.col("timestamp") > now - 60.0 * minutes)).agg(F.sum("switches")).head()[0] or 0
        total, interval = sum(r["frames"] for r in rows), self.config.get("capture_interval", 10)
        apps = {r["app_name"]: self._share(r["frames"], total, interval) for r in rows}
        return {"apps": apps, "switches": switches, "total_frames": total, "period_minutes": minutes}

    @staticmethod
    def _share(frames: int, total: int, interval: float) -> dict:
        """Minutes and percent rounded as Python does, to the even digit of the exact binary value."""
        return {"frames": frames, "estimated_minutes": round(frames * interval / 60, 1), "percent": round(frames / total * 100, 1)}

    def activity(self, minutes: float = 60, limit: int = 500) -> str:
        """The newest ``limit`` segments of each window in words, in order, and the most used applications."""
        now = self.clock()
        window = self._frames(now - 60.0 * minutes).where(F.col("timestamp") > now - 60.0 * minutes)
        found = activity.app_segments(window)
        newest = self._rows(found.orderBy(F.desc("start"), "user_id", F.desc("segment")).limit(limit))
        if not newest:
            return f"No activity in the last {minutes:g} minutes."
        lines = [f"Activity of the last {minutes:g} minutes:"]
        for r in sorted(newest, key=lambda r: (r["user_id"], r["segment"])):
            at = datetime.fromtimestamp(r["start"], timezone.utc).strftime("%H:%M")
            titles = " — " + ", ".join(r["titles"][:2]) if r["titles"] else ""
            lines.append(f"  {at} | {r['app_name'] or ''} ({max((r['end'] - r['start']) / 60, 0.15):.0f}min){titles}")
        focus = self._rows(frames.focus_stats(window, now, minutes, self.config.get("capture_interval", 10)))
        total, interval = sum(r["frames"] for r in focus), self.config.get("capture_interval", 10)
        lines += ["", "Focus:"]
        for r in focus[:5]:
            share = r["frames"] / total * 100
            lines.append(f"  {r['app_name'] or ''}: ~{round(r['frames'] * interval / 60, 1)}min ({share:.0f}%)")
        return "\n".join(lines)

    def sessions(self, hours: float = 8, limit: int = 200) -> list[dict]:
        """The newest ``limit`` sessions of the last ``hours``, oldest first."""
        start = self.clock() - 3600.0 * hours
        window = self._frames(start).where(F.col("timestamp") > start)
        found = activity.session_report(window, 60.0 * self.config.get("session_gap_minutes", 15))
        rows = self._rows(found.orderBy(F.desc("start"), "user_id").limit(limit))
        for r in rows:
            r["duration_minutes"] = round(max((r["end"] - r["start"]) / 60, 0.5), 1)
        return sorted(rows, key=lambda r: (r["start"], r["user_id"]))

    def stats(self) -> dict:
        return self.store.stats()


def argument(query: dict, name: str, default, cast=int):
    """A request's argument; one that can't be read is the default."""
    try:
        return cast(query[name][0])
    except (KeyError, IndexError, ValueError):
        return default


#: Routes and tools: name, description, arguments with type and default.
TOOLS = {
    "search": ("Ranked full-text search", {"q": (str, ""), "limit": (int, 20)}),
    "recent": ("Newest captures", {"minutes": (int, 30), "limit": (int, 50)}),
    "latest": ("The newest capture", {}),
    "activity": ("What was done, in words", {"minutes": (int, 60)}),
    "focus": ("Time by application", {"minutes": (int, 60)}),
}


def call(service: Service, name: str, arguments: dict):
    values = {k: arguments.get(k, default) for k, (_, default) in TOOLS[name][1].items()}
    if "q" in values:
        values["query"] = values.pop("q")
    return getattr(service, name)(**values)


def handler(service: Service):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            query, name = parse_qs(url.query), url.path.strip("/")
            try:
                if name == "health":
                    code, body = 200, service.health()
                elif name in TOOLS:
                    arguments = {k: argument(query, k, default, cast) for k, (cast, default) in TOOLS[name][1].items()}
                    code, body = 200, call(service, name, arguments)
                else:
                    code, body = 404, {"error": "not found"}
            except Exception as error:
                code, body = 500, {"error": str(error)}
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return Handler


def serve(service: Service, port: int = 0) -> HTTPServer:
    """An HTTP server on the loopback address; the caller runs it."""
    return HTTPServer(("127.0.0.1", port), handler(service))


def list_tools() -> list[dict]:
    kinds = {str: "string", int: "integer"}
    return [
        {"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": kinds[c], "default": v} for k, (c, v) in a.items()}}}
        for n, (d, a) in TOOLS.items()
    ]


def answer(service: Service, line: str) -> str:
    """One JSON request (``tools/list`` or ``tools/call``) to one JSON answer, for a tool server on standard streams."""
    request = json.loads(line)
    try:
        if request.get("method") == "tools/list":
            result = {"tools": list_tools()}
        elif request.get("method") == "tools/call":
            value = call(service, request["params"]["name"], request["params"].get("arguments") or {})
            text = value if isinstance(value, str) else json.dumps(value, indent=2, default=str)
            result = {"content": [{"type": "text", "text": text}]}
        else:
            raise KeyError(request.get("method"))
    except KeyError as error:
        return json.dumps({"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32601, "message": f"unknown: {error}"}})
    return json.dumps({"jsonrpc": "2.0", "id": request.get("id"), "result": result})
