"""Requests to tools: JSON-RPC lines as rows, and one request at a time for a server.

A table of requests is classified by Spark; only requests for a tool reach the driver's tools.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Methods of the protocol and its error codes.
METHODS = ["initialize", "ping", "tools/list", "tools/call", "resources/list", "resources/read", "resources/templates/list"]
SILENT = ["initialized", "notifications/initialized"]
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602
PROTOCOL = "2024-11-05"
GUIDE = "mcp://sedge/guide"

# The action names that one gateway tool takes, and the tool of each.
ACTIONS = [
    ("boost", "boost"), ("search", "search"), ("find_symbols", "find_symbols"), ("symbol", "find_symbols"), ("symbols", "find_symbols"), ("find", "find_symbols"),
    ("skeleton", "get_skeleton"), ("get_skeleton", "get_skeleton"), ("blast", "blast_radius"), ("blast_radius", "blast_radius"), ("distill", "distill_lesson"), ("distill_lesson", "distill_lesson"),
    ("genome", "get_genome"), ("get_genome", "get_genome"), ("darwin_record", "darwin_record"), ("darwin_search", "darwin_search"), ("sync", "sync"),
    ("context", "synthesize_context"), ("synthesize_context", "synthesize_context"), ("harness", "harness_status"), ("harness_status", "harness_status"),
    ("harness_feedback", "harness_feedback"), ("feedback", "harness_feedback"), ("harness_eval", "harness_eval"), ("eval", "harness_eval"),
]

#: Each tool's required and optional parameters with their defaults (None: none).
TOOLS: dict[str, tuple[list[str], dict]] = {
    "boost": (["task"], {"max_tokens": 600}),
    "search": (["query"], {"limit": 20}),
    "find_symbols": (["query"], {"entity_type": None, "exact": False, "limit": 50, "path": None}),
    "get_skeleton": (["path"], {"focus_symbol": None, "max_tokens": 600}),
    "blast_radius": ([], {"file": None, "files": None, "symbol": None, "max_depth": 3, "max_tokens": 250}),
    "distill_lesson": (["traceback"], {"diff": None, "fix": None, "scope": None, "auto_register": True, "sync_targets": None}),
    "get_genome": ([], {}),
    "synthesize_context": (["task"], {}),
    "darwin_record": (["name", "content"], {"artifact_type": "pattern", "success": True, "scope": "general", "tags": None}),
    "darwin_search": ([], {"query": "", "scope": None, "tags": None}),
    "sync": ([], {"target": "all"}),
    "harness_status": ([], {}),
    "harness_feedback": (["feedback_type", "content"], {"scope": "global", "task": ""}),
    "harness_eval": ([], {}),
}


def classify(lines: DataFrame) -> DataFrame:
    """n, outcome ('ok', 'silent' or 'error') and code (0 or that of the error) of each line."""
    read = lines.withColumns({"_v": F.try_parse_json("line")})
    method = F.try_variant_get(F.col("_v"), "$.method", "string")
    uri = F.rtrim(F.try_variant_get(F.col("_v"), "$.params.uri", "string"), F.lit("/"))
    code = (
        F.when(F.col("_v").isNull(), PARSE_ERROR)
        .when(F.coalesce(method, F.lit("")) == "", INVALID_REQUEST)
        .when(method.isin(*SILENT), 0)
        .when(~method.isin(*METHODS), METHOD_NOT_FOUND)
        .when((method == "resources/read") & ~uri.eqNullSafe(F.lit(GUIDE)), INVALID_PARAMS)
        .otherwise(0)
    )
    outcome = F.when(code != 0, "error").when(method.isin(*SILENT), "silent").otherwise("ok")
    return read.select("n", outcome.alias("outcome"), code.cast("long").alias("code"))


def tools_of(calls: DataFrame) -> DataFrame:
    """calls (action and more) with the tool of each action that is known."""
    known = calls.sparkSession.createDataFrame(ACTIONS, "action string, tool string")
    return calls.join(F.broadcast(known), "action")


def routed(arguments: dict) -> tuple[str, dict]:
    """The tool and parameters of a call of the gateway: params may be an object or JSON text, and
    what stands beside them fills gaps."""
    action, params = arguments.get("action"), arguments.get("params")
    if not action:
        raise ValueError("Missing required 'action' parameter")
    if isinstance(params, str):
        try:
            params = json.loads(params)
        except ValueError:
            params = {}
    params = {k: v for k, v in arguments.items() if k not in ("action", "params")} | (params if isinstance(params, dict) else {})
    if action == "darwin":
        return ("darwin_record" if {"content", "name"} & params.keys() else "darwin_search"), params
    tool = dict(ACTIONS).get(action)
    if not tool:
        raise ValueError(f"Unknown action '{action}'. Valid actions: {sorted({a for a, _ in ACTIONS})}")
    return tool, params


class Server:
    """Answers requests about one project (see engine.Project)."""

    def __init__(self, project, profile: str = "standard"):
        self.project, self.profile = project, profile

    def manifest(self) -> list[dict]:
        names = {"gateway": (["action"], {"params": None})} if self.profile == "full" else {}
        return [{"name": n, "inputSchema": {"type": "object", "properties": {p: {} if d is None else {"default": d} for p, d in [*((r, None) for r in required), *optional.items()]}, "required": required}} for n, (required, optional) in (names | TOOLS).items()]

    def call(self, name: str, arguments: dict) -> str:
        from sedge.engine import as_text, pretty

        if name == "gateway":
            name, arguments = routed(arguments)
        if name not in TOOLS:
            raise ValueError(f"Unknown tool '{name}'")
        required, optional = TOOLS[name]
        a = optional | {k: v for k, v in arguments.items() if v is not None}
        if name == "get_skeleton":
            a["path"] = a.get("path") or a.get("file_path") or a.get("file")
            a["focus_symbol"] = a["focus_symbol"] or a.get("focus")
        for r in required:
            if not a.get(r):
                raise ValueError(f"Missing required '{r}' parameter for {name}")
        p = self.project
        run: dict[str, Callable[[], str]] = {
            "boost": lambda: p.boost(a["task"], int(a["max_tokens"])),
            "search": lambda: as_text(p.search(a["query"], int(a["limit"])), score=True),
            "find_symbols": lambda: as_text(p.find_symbols(a["query"], a["entity_type"], a["exact"], int(a["limit"]), a["path"])),
            "get_skeleton": lambda: p.skeleton(a["path"], a["focus_symbol"], int(a["max_tokens"]))[0],
            "blast_radius": lambda: p.impact_text(p.impact(a["files"] or ([a["file"]] if a["file"] else None), a["symbol"], int(a["max_depth"])), int(a["max_tokens"])),
            "distill_lesson": lambda: self.distill(a),
            "get_genome": lambda: p.genome.compact(),
            "synthesize_context": lambda: p.genome.task_context(a["task"]),
            "darwin_record": lambda: f"Registered and recorded artifact {p.remember(a['name'], a['content'], a['artifact_type'], a['scope'], a['tags'], a['success'])} '{a['name']}'.",
            "darwin_search": lambda: "\n".join(p.recall(a["query"], a["scope"], a["tags"])) or "No matching patterns found.",
            "sync": lambda: f"Successfully synchronized target(s): {json.dumps(p.sync(a['target']))}",
            "harness_status": lambda: pretty(p.status()),
            "harness_feedback": lambda: pretty(p.feedback(a["feedback_type"], a["content"], a["scope"], a["task"])),
            "harness_eval": lambda: pretty({k: v for k, v in p.status().items() if k != "recent_episodes"}),
        }
        return run[name]()

    def distill(self, a: dict) -> str:
        from sedge.engine import pretty

        found = self.project.distill(a["traceback"], a["diff"], a["fix"], a["scope"], a["auto_register"])
        if a["sync_targets"]:
            self.project.sync(a["sync_targets"])
        return pretty(found)

    def answer(self, request) -> dict | None:
        """The reply to one parsed request; None for a notification."""
        request = request if isinstance(request, dict) else {}
        method, params = request.get("method"), request.get("params")
        params = params if isinstance(params, dict) else {}
        base = {"jsonrpc": "2.0", "id": request.get("id")}
        fails = lambda code, message: base | {"error": {"code": code, "message": message}}
        if not method:
            return fails(INVALID_REQUEST, "Invalid Request: missing method")
        if method in SILENT:
            return None
        if method == "tools/call":
            name, arguments = params.get("name"), params.get("arguments")
            try:
                text, failed = self.call(name, arguments if isinstance(arguments, dict) else {}), {}
            except Exception as e:  # a tool's failure is a reply, not the server's end
                text, failed = f"Error executing tool {name}: {e}", {"isError": True}
            return base | {"result": {"content": [{"type": "text", "text": text}]} | failed}
        if method == "resources/read":
            if str(params.get("uri") or "").rstrip("/") != GUIDE:
                return fails(INVALID_PARAMS, f"Resource not found: {params.get('uri')}")
            return base | {"result": {"contents": [{"uri": GUIDE, "mimeType": "text/markdown", "text": self.guide()}]}}
        results = {
            "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "sedge", "version": "0.1.0"}},
            "ping": dict,
            "tools/list": lambda: {"tools": self.manifest()},
            "resources/list": lambda: {"resources": [{"uri": GUIDE, "name": "Guide", "mimeType": "text/markdown"}]},
            "resources/templates/list": lambda: {"resourceTemplates": []},
        }
        return base | {"result": results[method]()} if method in results else fails(METHOD_NOT_FOUND, f"Method not found: {method}")

    def guide(self) -> str:
        return "# Tools\n\n" + "\n".join(f"* `{n}`: needs {', '.join(r) or 'nothing'}; takes {', '.join(o) or 'nothing more'}" for n, (r, o) in TOOLS.items()) + "\n"

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """Replies to lines of JSON, blank ones left out."""
        for line in filter(None, map(str.strip, lines)):
            try:
                reply = self.answer(json.loads(line))
            except Exception as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"Parse error or fatal exception: {e}"}}
            if reply is not None:
                yield json.dumps(reply)
