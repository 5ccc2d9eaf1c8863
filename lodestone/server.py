"""Tools over JSON-RPC on standard input and output, a message a line, on one Spark session."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import api
from lodestone.documents import Options
from lodestone.operators import parsing, stats, transform
from lodestone.operators.tokens import proxy

PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
MAX_FILES = 20


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class ToolError(Exception):
    """A failure that the caller is told of as the tool's result."""


def _value(args: dict, key: str, kind: type | tuple, said: str, choices: tuple = ()) -> object:
    v = args.get(key)
    if v is None:
        return None
    if not isinstance(v, kind) or isinstance(v, bool) and kind is not bool:
        raise RpcError(INVALID_PARAMS, f'"{key}" must be {said}')
    if kind is list and not all(isinstance(x, str) for x in v):
        raise RpcError(INVALID_PARAMS, f'"{key}" must be {said}')
    if kind == (int, float) and v <= 0:
        raise RpcError(INVALID_PARAMS, f'"{key}" must be {said}')
    if choices and v not in choices:
        raise RpcError(INVALID_PARAMS, f'"{key}" must be one of {", ".join(choices)}')
    return v


def text_of(args: dict, key: str, choices: tuple = ()) -> str | None:
    return _value(args, key, str, "a string", choices)


def strings_of(args: dict, key: str) -> list[str]:
    return _value(args, key, list, "an array of strings") or []


def number_of(args: dict, key: str) -> int | None:
    v = _value(args, key, (int, float), "a positive number")
    return None if v is None else int(v)


class Server:
    """Answers messages; transport is :func:`serve`'s. Tools read only below ``roots``, after following links."""

    def __init__(self, spark: SparkSession, roots: list[str], cwd: str | None = None) -> None:
        self.spark = spark
        self.roots = [os.path.realpath(r) for r in roots]
        self.cwd = os.path.abspath(cwd or self.roots[0])
        strings, text, number = {"type": "array", "items": {"type": "string"}}, {"type": "string"}, {"type": "number"}
        comments = {"enum": ["all", "docs", "none"]}
        common = {"path": text, "focus": strings, "changed": text, "query": text, "queryLimit": number, "order": {"enum": list(api.ORDERS)}, "related": number, "mode": {"enum": ["skeleton", "full", "outline"]}, "comments": comments, "include": strings, "ignore": strings, "maxTokens": number}
        self.tools: dict[str, tuple[str, dict, Callable[[dict], dict]]] = {
            "pack_codebase": ("A project as one document: its tree and all files without the bodies of functions.", {**common, "format": {"enum": ["markdown", "xml", "json"]}, "deps": {"type": "boolean"}}, self.pack_codebase),
            "estimate_tokens": ("What pack_codebase would return, in tokens, and the largest files.", {**common, "top": number}, self.estimate_tokens),
            "skeleton_file": (f"Up to {MAX_FILES} source files without the bodies of functions.", {"path": text, "paths": strings, "comments": comments}, self.skeleton_file),
        }

    def handle(self, message: object) -> dict | None:
        """The answer to one message; None for notifications."""
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0":
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "no JSON-RPC 2.0 message"}}
        number, silent = message.get("id"), "id" not in message
        if not isinstance(message.get("method"), str):
            return None if silent else {"jsonrpc": "2.0", "id": number, "error": {"code": INVALID_REQUEST, "message": "no method"}}
        try:
            result = self.dispatch(message["method"], message.get("params") or {})
        except Exception as e:  # every failure is an answer
            return None if silent else {"jsonrpc": "2.0", "id": number, "error": {"code": getattr(e, "code", INTERNAL), "message": str(e)}}
        return None if silent else {"jsonrpc": "2.0", "id": number, "result": result}

    def dispatch(self, method: str, params: dict) -> object:
        if method == "initialize":
            asked = params.get("protocolVersion")
            return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lodestone", "version": "1"}, "instructions": "Read code as skeletons to understand it; read whole files to change them."}
        if method in ("notifications/initialized", "notifications/cancelled"):
            return None
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "additionalProperties": False}} for n, (d, p, _) in self.tools.items()]}
        if method == "tools/call":
            name, args = text_of(params, "name"), params.get("arguments") or {}
            if name not in self.tools:
                raise RpcError(INVALID_PARAMS, f"no such tool: {name}")
            if not isinstance(args, dict):
                raise RpcError(INVALID_PARAMS, '"arguments" must be an object')
            try:
                return self.tools[name][2](args)
            except RpcError:
                raise
            except Exception as e:
                return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}
        raise RpcError(NO_METHOD, f"no such method: {method}")

    def resolved(self, path: str) -> str:
        """The real path, which must lie below a root."""
        full = os.path.join(self.cwd, path)
        if not os.path.exists(full):
            raise ToolError(f"{path} does not exist")
        real = os.path.realpath(full)
        if not any(real == r or real.startswith(r.rstrip(os.sep) + os.sep) for r in self.roots):
            raise ToolError(f"{path} is outside the allowed roots ({', '.join(self.roots)})")
        return real

    def _packed(self, args: dict, form: str) -> tuple[str, api.Pack, object, Options]:
        # All arguments are looked at before any file.
        mode, comments, order = text_of(args, "mode", ("skeleton", "full", "outline")) or "skeleton", text_of(args, "comments", ("all", "docs", "none")) or "all", text_of(args, "order", api.ORDERS) or "path"
        focus, include, ignore = (strings_of(args, k) for k in ("focus", "include", "ignore"))
        changed, query = text_of(args, "changed"), text_of(args, "query")
        limit, hops, budget = number_of(args, "queryLimit") or 5, number_of(args, "related") or 0, number_of(args, "maxTokens")
        root = self.resolved(text_of(args, "path") or ".")
        if not os.path.isdir(root):
            raise ToolError(f"{root} is not a directory")
        options = Options(deps=args.get("deps") is True)
        result = api.pack(self.spark, root, mode, comments, focus, query, limit, hops, changed=changed, order=order, cwd=root, deps=options.deps, ignore="\n".join(ignore), include="\n".join(include))
        plan = None
        if budget:
            result, plan = api.fit(result, budget, form, options)
        return root, result, plan, options

    def _counts(self, result: api.Pack, document: str, top: int) -> dict:
        tokens = self.spark.createDataFrame([(document,)], "t string").select(proxy(F.col("t")).alias("n")).first()["n"]
        return api.statistics(result, tokens, len(document), top=top)

    def pack_codebase(self, args: dict) -> dict:
        form = text_of(args, "format", ("markdown", "xml", "json")) or "markdown"
        root, result, _, options = self._packed(args, form)
        document = api.render(result, os.path.basename(root), form, options)
        told = self._counts(result, document, 10)
        t = told["tokens"]
        return {"content": [{"type": "text", "text": document}], "structuredContent": {"files": told["files"]["included"], "tokens": t["output"], "rawTokens": t["baseline"], "savedPercent": round(told["savedRatio"] * 100), "document": document}}

    def estimate_tokens(self, args: dict) -> dict:
        top = number_of(args, "top") or 10
        root, result, plan, options = self._packed(args, "markdown")
        told = self._counts(result, api.render(result, os.path.basename(root), "markdown", options), top)
        f, t = told["files"], told["tokens"]
        lines = []
        if plan is not None:
            moved = [r["now"] for r in plan.changes.collect()]
            gone = moved.count("omitted")
            lines.append(f"Budget {plan.limit}: {'fits' if plan.fits else 'does not fit'} ({len(moved) - gone} files compressed, {gone} omitted)")
        lines += [f"Files: {f['included']} included, {f['scanned'] - f['included']} skipped", f"Tokens: {t['output']} packed, {t['baseline']} raw ({round(told['savedRatio'] * 100)}% saved)", "", "Largest files (packed / raw):"]
        lines += [f"  {r['path']}: {r['tokens']} / {r['raw']}{' [focus]' if r['focused'] else ''}" for r in told["filesByTokens"]]
        return {"content": [{"type": "text", "text": "\n".join(lines)}], "structuredContent": {"files": f["included"], "tokens": t["output"], "rawTokens": t["baseline"], "savedPercent": round(told["savedRatio"] * 100), "largest": [{"path": r["path"], "tokens": r["tokens"], "rawTokens": r["raw"]} for r in told["filesByTokens"]], "summary": "\n".join(lines)}}

    def skeleton_file(self, args: dict) -> dict:
        one, many, comments = text_of(args, "path"), strings_of(args, "paths"), text_of(args, "comments", ("all", "docs", "none")) or "all"
        asked = [*([one] if one else []), *many]
        if not asked:
            raise ToolError("pass path or paths")
        if len(asked) > MAX_FILES:
            raise ToolError(f"at most {MAX_FILES} files a call")
        got = []
        for path in asked:
            real = self.resolved(path)
            if not os.path.isfile(real):
                raise ToolError(f"{path} is not a file")
            with open(real, encoding="utf-8", errors="replace") as f:
                text = f.read().removeprefix("﻿").replace("\r\n", "\n")
            out = parsing.transform_text(real, text, "skeleton", comments, 400, 40_000)
            out.content = transform.redact_text(out.content)
            got.append((path, out, text))
        rows = self.spark.createDataFrame([(k, o.content, t) for k, (_, o, t) in enumerate(got)], "k int, content string, original string")
        counts = {r["k"]: r for r in rows.select("k", stats.token_proxy(F.col("content")).alias("n"), stats.token_proxy(F.col("original")).alias("raw")).collect()}
        meta = [{"path": p, "language": o.language, "strategy": o.strategy, "tokens": counts[k]["n"], "rawTokens": counts[k]["raw"], "skeleton": o.content} for k, (p, o, _) in enumerate(got)]
        text = got[0][1].content if len(got) == 1 else "\n".join(f"### {p}\n\n{o.content.rstrip(chr(10))}\n" for p, o, _ in got)
        return {"content": [{"type": "text", "text": text}], "structuredContent": meta[0] if len(meta) == 1 else {"files": meta}}


def serve(server: Server, source=None, sink=None, workers: int = 4) -> None:
    """Answer lines until the source ends. Messages of one line may be a batch; answers come as they are done, a line each."""
    source, sink, lock = source or sys.stdin, sink or sys.stdout, Lock()

    def say(answer: object) -> None:
        if answer:
            with lock:
                sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
                sink.flush()

    def work(line: str) -> None:
        try:
            message = json.loads(line)
        except ValueError:
            say({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "no JSON"}})
            return
        if isinstance(message, list) and message:
            say([a for m in message if (a := server.handle(m)) is not None])
        else:
            say(server.handle(message))

    with ThreadPoolExecutor(workers) as pool:
        for line in source:
            if line.strip():
                pool.submit(work, line)
