"""Command line and JSON-RPC over standard input and output."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from .graph import CodeGraph, LiveGraph
from .operators import targets
from .schemas import DEFAULT_BUDGET, DEFAULT_DEPTH
from .sources import files

PROTOCOLS = ["2025-06-18", "2025-03-26", "2024-11-05"]


def _text(said: str) -> dict:
    return {"type": "string", "description": said}


_NAME = {"name": _text("A symbol's name, with its owner or module before :: or . if need be; or a file's path.")}
_DEPTH = {"depth": {"type": "integer", "description": f"Steps to follow at most ({DEFAULT_DEPTH} if not given)."}}
_QUERY = _text("Words, and filters like kind:function, lang:rust, file:src, owner:Store, calls:save, returns:Result, name:load.")
#: Tool: (what it tells, arguments, required ones).
TOOLS = {
    "index": ("Read the tree, or what changed in it since the last time.", {}, []),
    "status": ("How far the index is behind the tree, and how old it is.", {}, []),
    "definition": ("Where a name is defined.", _NAME, ["name"]),
    "references": ("Each place that refers to a name.", _NAME, ["name"]),
    "callers": ("What calls a name, directly or through others.", {**_NAME, **_DEPTH}, ["name"]),
    "callees": ("What a name calls, directly or through others.", {**_NAME, **_DEPTH}, ["name"]),
    "blast_radius": ("Everything that a change of a name or a file can reach.", _NAME, ["name"]),
    "dependency_graph": ("Which file imports which, and the cycles among them.", {}, []),
    "structural_search": ("Symbols that fit all filters and words.", {"query": _QUERY}, ["query"]),
    "find": ("Symbols by what they do, in plain words, best first; filters may be among them.", {"query": _QUERY}, ["query"]),
    "repo_map": ("The signatures that matter most, by file, around what is in focus.", {"focus": {"type": "array", "items": {"type": "string"}, "description": "Names or paths that are being worked on."}}, []),
    "repo_summary": ("Languages, sizes, largest files, central symbols and how well calls are bound.", {}, []),
    "diff_impact": ("What a change touches, what depends on that, and the tests to run.", {"diff": _text("A unified diff; without it, the tree against git."), "base": _text("What git compares with (HEAD if not given).")}, []),
}
_BUDGET = {"max_tokens": {"type": "integer", "description": f"Size of the answer at most ({DEFAULT_BUDGET} if not given)."}}


#: Columns that budgets work with; results leave them out.
_WORKING = ("cost", "rn", "used", "more", "header")


class UnknownTool(ValueError):
    pass


class MissingArgument(ValueError):
    pass


def _rows(frame) -> list[dict]:
    """Rows of a result that a budget has bounded, without null fields."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in frame.collect()]


def _kept(rows: list[dict]) -> dict:
    """A4: the rows, how many, and whether the budget cut any (told only by prefix budgets)."""
    out = {"count": len(rows)}
    if rows and "more" in rows[0]:
        out["truncated"] = max(rows, key=lambda r: r["rn"])["more"]
    return out | {"results": [{k: v for k, v in r.items() if k not in _WORKING} for r in rows]}


def call(graph: CodeGraph | None, root: str, tool: str, given: dict, live: LiveGraph | None = None) -> dict:
    """Run a tool; the result is ready for JSON.  With ``live`` the graph is brought up to date first, and the answer says how fresh it is."""
    if tool not in TOOLS:
        raise UnknownTool(tool)
    missing = [a for a in TOOLS[tool][2] if a not in given]
    if missing:
        raise MissingArgument(", ".join(missing))
    if live and tool == "index":
        return {"kind": tool, **live.refresh()}
    if live and tool == "status":
        return {"kind": tool, **_rows(live.status())[0]}
    if not live:
        return _ask(graph, root, tool, given)
    told = live.ensure_fresh()
    return _ask(live.graph, root, tool, given) | {"freshness": told}


def _ask(graph: CodeGraph, root: str, tool: str, given: dict) -> dict:
    most = given.get("max_tokens", DEFAULT_BUDGET)
    if tool in ("index", "status"):
        symbols, edges = graph.counts()
        return {"kind": tool, "files": graph.files().count(), "symbols": symbols, "edges": edges}
    if tool == "repo_summary":
        return {"kind": tool, **{k: _kept(_rows(v)) if k == "central" else _rows(v) for k, v in graph.repo_summary(most).items()}}
    if tool == "diff_impact":
        spark = graph.symbols.sparkSession
        lines = files.diff_lines(spark, given["diff"]) if "diff" in given else files.git_diff(spark, root, given.get("base", "HEAD"))
        told = graph.impact(lines, most)
        risk = _rows(told["risk"])[0]
        out = _kept(_rows(told["results"]))
        out["truncated"] = out["count"] < risk["symbols_changed"] + risk["tests_impacted"] + risk["symbols_impacted"]
        return {"kind": tool, "base": given.get("base", "diff" if "diff" in given else "HEAD"), "risk": risk, "changed_files": [r["file"] for r in _rows(told["changed_files"])], **out}
    if tool == "repo_map":
        out = {"kind": tool, "focus": given.get("focus") or [], **_kept(_rows(graph.repo_map(given.get("focus"), most)))}
        near = graph.focus_suggestions(given.get("focus"))
        return out | ({"suggestions": near} if near else {})
    if tool == "dependency_graph":
        return {"kind": tool, **_kept(_rows(graph.dependency_graph(most))), "cycles": _cycles(graph)}
    if tool in ("callers", "callees"):
        rows = _rows(getattr(graph, tool)(given["name"], given.get("depth", DEFAULT_DEPTH), most))
    else:
        rows = _rows(getattr(graph, tool)(given.get("name", given.get("query")), most))
    out = {"kind": tool, "query": given.get("name", given.get("query")), **_kept(rows)}
    if "name" in given and not rows:
        out["suggestions"] = [r["name"] for r in targets.suggest(graph.symbols, given["name"]).collect()]  # five at most
    return out


#: Files on cycles that an answer names at most.
MOST_CYCLE_FILES = 1000


def _cycles(graph: CodeGraph) -> list[list[str]]:
    """Files that import each other, a list for each cycle's component."""
    out: dict[str, list[str]] = {}
    for row in graph.cycles().orderBy("component", "node").limit(MOST_CYCLE_FILES).collect():
        out.setdefault(row["component"], []).append(row["node"])
    return list(out.values())


def human(out: dict) -> str:
    """An answer as lines to read."""
    kind, lines = out["kind"], []
    if kind in ("index", "status"):
        return "\n".join(f"{k}: {v}" for k, v in out.items() if k != "kind")
    if kind == "repo_summary":
        counts, calls = out["counts"][0], out["calls"][0]
        lines += [f"{counts['files']} files, {counts['symbols']} symbols, {counts['edges']} edges", "languages: " + ", ".join(f"{r['language']} ({r['symbols']})" for r in out["languages"])]
        lines.append(f"calls: {calls['resolved']} of {calls['sites']} bound, {calls['ambiguous']} ambiguous, {calls['confident']:.0%} sure")
        lines += [f"{r['symbols']:>6}  {r['file']}" for r in out["largest"]] + [_line(r) for r in out["central"]["results"]]
    elif kind == "dependency_graph":
        lines += [f"{r['from_file']} -> {r['import_text']}" + (f" ({r['to_file']})" if "to_file" in r else "") for r in out["results"]]
        lines += ["cycle: " + " -> ".join(c) for c in out["cycles"]]
    elif kind == "repo_map":
        by_file: dict[str, list[dict]] = {}
        for r in out["results"]:
            by_file.setdefault(r["file"], []).append(r)
        for file, rows in by_file.items():
            lines += [f"{file}:"] + [f"{r['line_start']:>6}  {r.get('signature') or r['name']}" for r in sorted(rows, key=lambda r: r["line_start"])]
    else:
        if kind == "diff_impact":
            lines.append(", ".join(f"{v} {k.replace('_', ' ')}" for k, v in out["risk"].items()))
        for r in out["results"]:
            mark = ("changed", "test", "reached")[r["section"]] + " " if "section" in r else f"{r['relative']:.2f} " if "relative" in r else ""
            lines.append(mark + _line(r))
    if out.get("truncated"):
        lines.append("(cut to the budget)")
    if out.get("suggestions"):
        lines.append("did you mean: " + ", ".join(out["suggestions"]))
    return "\n".join(lines)


def _line(r: dict) -> str:
    name = f"{r['owner']}::{r['name']}" if r.get("owner") else r["name"]
    deep = f" (depth {r['depth']})" if r.get("depth") else ""
    return f"{r.get('kind', '')} {name} {r['file']}:{r.get('site_line', r.get('line_start', ''))}{deep}"


def answer(graph: CodeGraph | None, root: str, request: dict, live: LiveGraph | None = None) -> dict | None:
    """The reply to a JSON-RPC request; none to a notification."""
    number, method, given = request.get("id"), request.get("method"), request.get("params") or {}
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        asked = given.get("protocolVersion")
        return reply | {"result": {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        hints = lambda n: {"readOnlyHint": n != "index", "destructiveHint": False, "idempotentHint": True, "openWorldHint": False}
        return reply | {"result": {"tools": [{"name": n, "title": n.replace("_", " "), "description": said, "inputSchema": {"type": "object", "properties": {**a, **_BUDGET}, "required": r}, "annotations": hints(n)} for n, (said, a, r) in TOOLS.items()]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    try:
        out, failed = json.dumps(call(graph, root, given.get("name", ""), given.get("arguments") or {}, live), default=str), False
    except (UnknownTool, MissingArgument) as error:
        return reply | {"error": {"code": -32602, "message": f"{type(error).__name__}: {error}"}}
    except Exception as error:  # an execution failure is told in the result
        out, failed = str(error), True
    return reply | {"result": {"content": [{"type": "text", "text": out}], "isError": failed}}


def serve(graph: CodeGraph | None, root: str, lines=sys.stdin, out=sys.stdout, live: LiveGraph | None = None) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            logging.warning("skipped a line that is no JSON")
            continue
        reply = answer(graph, root, request, live)
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("verb", choices=[*TOOLS, "serve"])
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--path", default=".")
    parser.add_argument("--store")
    parser.add_argument("--depth", type=int, default=DEFAULT_DEPTH)
    parser.add_argument("--max-tokens", type=int, default=DEFAULT_BUDGET)
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--no-refresh", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(arguments)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if given.verbose else logging.WARNING)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    names = TOOLS[given.verb][2] if given.verb in TOOLS else []
    wanted = {names[0]: given.argument} if names and given.argument else {}
    if given.verb == "repo_map" and given.argument:
        wanted = {"focus": given.argument.split(",")}
    live = LiveGraph(spark, given.path, given.store, interval=0.25 if given.verb == "serve" else 0.0, load=given.verb not in ("index", "status")) if given.store and not given.no_refresh else None
    graph = None if live else CodeGraph.load(spark, given.store) if given.store else CodeGraph.build(spark, given.path)
    if given.verb == "serve":
        serve(graph, given.path, live=live)
        return 0
    out = call(graph, given.path, given.verb, wanted | {"max_tokens": given.max_tokens, "depth": given.depth}, live)
    print(json.dumps(out, indent=2, default=str) if given.json else human(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
