"""JSON-RPC over standard input and output: initialize, tools/list and tools/call."""

from __future__ import annotations

import json
import sys

from packwright.cli import plain

_TEXT, _COUNT = {"type": "string"}, {"type": "integer", "minimum": 1, "maximum": 100}
TOOLS = {
    "query_kb": {"q": _TEXT, "role": _TEXT, "target": _TEXT, "limit": _COUNT, "domain": _TEXT, "version": _TEXT, "exact": {"type": "boolean"}},
    "query_code": {"command": _TEXT, "q": _TEXT, "target": _TEXT, "limit": _COUNT},
    "query_config": {"command": _TEXT, "q": _TEXT, "target": _TEXT, "limit": _COUNT},
    "resolve_packs": {"target": _TEXT, "role": _TEXT},
    "status": {},
    "ensure": {"needs": {"type": "array", "items": _TEXT}, "sources": {"type": "array", "items": _TEXT}, "out": _TEXT},
}


def call(engine, name: str, args: dict) -> str:
    if name == "query_kb":
        q, role = args.pop("q"), args.pop("role", "platform")
        return plain(engine.search(q, role, **args))
    if name in ("query_code", "query_config"):
        run = engine.code if name == "query_code" else engine.config
        return plain(run(args["command"], args.get("q", ""), args.get("target"), args.get("limit", 20)))
    if name == "resolve_packs":
        role = args.get("role")
        return plain(engine.workspace.resolve(role, args.get("target")) if role else engine.workspace.resolve_all(args.get("target")))
    if name == "ensure":
        return plain(engine.ensure(args["needs"], args["sources"], args["out"]))
    if name == "status":
        return plain(engine.status())
    raise KeyError(f"unknown tool: {name}")


def handle(engine, line: str) -> dict | None:
    """The response to one message; notifications have none, tool failures are results marked as errors."""
    try:
        message = json.loads(line)
    except json.JSONDecodeError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "packwright", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p}} for n, p in TOOLS.items()]}
    elif method == "tools/call":
        try:
            text, failed = call(engine, params.get("name", ""), dict(params.get("arguments") or {})), False
        except Exception as e:  # a failing tool must not end the server
            text, failed = f"{type(e).__name__}: {e}", True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32000, "message": f"unknown method: {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(engine, source=sys.stdin, out=sys.stdout) -> None:
    for line in source:
        if line.strip() and (response := handle(engine, line)) is not None:
            print(json.dumps(response, ensure_ascii=False), file=out, flush=True)
