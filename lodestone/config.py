"""Options of a pack: what a configuration file may hold, presets, and which value wins."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from lodestone.functions.paths import EXTENSIONS

FILES = ("lodestone.config.json", ".lodestone.json")
LANGUAGES = sorted(EXTENSIONS)
#: Key, kind and meaning. A tuple is a choice.
SCHEMA: dict[str, tuple[object, str]] = {
    "output": ("string", "Where the document is written."),
    "stdout": ("boolean", "Write the document to standard output."),
    "format": (("markdown", "xml", "json"), "How the document is laid out."),
    "mode": (("skeleton", "full", "outline"), "How much of source files is shown."),
    "focus": ("strings", "Paths, folders or globs that stay whole."),
    "related": ("number", "Import steps around focused files that stay whole too."),
    "query": ("string", "Words whose best matches stay whole."),
    "queryLimit": ("number", "How many matches, at most."),
    "ignore": ("strings", "More ignore patterns."),
    "include": ("strings", "Only what matches one of these patterns."),
    "defaultIgnores": ("boolean", "Leave out dependencies, lock files, binaries and secrets."),
    "maxFileSize": ("size", "The largest file; 0 for none."),
    "fallbackLines": ("number", "Lines kept of files without a parser."),
    "fallbackChars": ("number", "Characters kept of files without a parser."),
    "comments": (("all", "docs", "none"), "Which comments stay."),
    "maxTokens": ("count", "The budget of the whole document."),
    "splitTokens": ("count", "The budget of each part."),
    "tree": ("boolean", "Show the directory tree."),
    "order": (("path", "stable", "size"), "The order of files."),
    "deps": ("boolean", "Show which file imports which."),
    "instructions": ("string", "Text put in front, or @file."),
    "followSymlinks": ("boolean", "Follow links, each folder once."),
    "redact": ("boolean", "Mask secrets."),
    "changed": ("string or boolean", "Focus what changed since a reference."),
    "diff": ("string or boolean", "Show what changed since a reference."),
    "models": ("strings", "Models whose cost is told."),
    "top": ("number", "How many of the largest files are told."),
    "preset": ("string", "A named set of options."),
    "extensions": ("languages", "Extensions or names and their languages."),
}
#: Ready-made options; explicit ones and those of a file win.
PRESETS: dict[str, dict] = {
    "review": {"changed": "@base", "diff": True, "comments": "docs", "instructions": "Review the change in the diff. Files marked [focus] are whole, all else is context. Name bugs, unsafe code and missing tests first, with file, line and a fix."},
    "explain": {"mode": "outline", "deps": True, "instructions": "Explain how this code is built: its parts, what each is for, how data passes between them, and where a newcomer should begin."},
    "refactor": {"deps": True, "comments": "docs", "instructions": "Plan a refactoring of the files marked [focus] in small steps that each can be shipped, with all callers that they touch."},
    "debug": {"comments": "all", "instructions": "Find the cause of a fault in the files marked [focus]; the rest is context. The fault: <describe it here>"},
}


class ConfigError(ValueError):
    """A configuration that can't be used."""


def _check(key: str, value: object, kind: object) -> None:
    def fail(wanted: str) -> None:
        raise ConfigError(f'"{key}" must be {wanted}, got {json.dumps(value)}')

    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, tuple):
        if value not in kind:
            fail("one of " + ", ".join(kind))
    elif kind == "string" and not isinstance(value, str):
        fail("a string")
    elif kind == "boolean" and not isinstance(value, bool):
        fail("a boolean")
    elif kind == "number" and not (number and value >= 0):
        fail("a non-negative number")
    elif kind == "strings" and not (isinstance(value, list) and all(isinstance(x, str) for x in value)):
        fail("an array of strings")
    elif kind in ("size", "count") and not (number or isinstance(value, str)):
        fail("a number or string")
    elif kind == "string or boolean" and not isinstance(value, (str, bool)):
        fail("a string or boolean")
    elif kind == "languages" and not (isinstance(value, dict) and all(v in LANGUAGES for v in value.values())):
        fail("an object whose values are languages: " + ", ".join(LANGUAGES))


def validate(raw: object) -> tuple[dict, list[str]]:
    """The known options of a parsed file, and warnings for unknown keys."""
    if not isinstance(raw, dict):
        raise ConfigError("a configuration must be a JSON object")
    out, warnings = {}, []
    for key, value in raw.items():
        if key == "$schema":
            continue
        if key not in SCHEMA:
            warnings.append(f'unknown key "{key}"')
            continue
        _check(key, value, SCHEMA[key][0])
        out[key] = value
    return out, warnings


def find(folders: Iterable[str | Path]) -> Path | None:
    """The first configuration file in some folders."""
    return next((p for f in folders for n in FILES if (p := Path(f) / n).is_file()), None)


def load(path: str | Path) -> tuple[dict, list[str]]:
    """A file's options; paths in it are relative to it, but for ``focus``, which names files of the project."""
    path = Path(path)
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    try:
        config, warnings = validate(raw)
    except ConfigError as e:
        raise ConfigError(f"{path}: {e}") from e
    if "output" in config:
        config["output"] = str(path.parent / config["output"])
    if config.get("instructions", "").startswith("@"):
        config["instructions"] = "@" + str(path.parent / config["instructions"][1:])
    return config, [f"{path}: {w}" for w in warnings]


def merged(explicit: dict, config: dict | None = None, preset: str | None = None) -> dict:
    """Explicit options win over the file's, these over the preset's; lists of patterns are joined instead."""
    config = config or {}
    preset = preset or explicit.get("preset") or config.get("preset")
    if preset and preset not in PRESETS:
        raise ConfigError(f"unknown preset {preset}; there are {', '.join(PRESETS)}")
    out = {**(PRESETS[preset] if preset else {}), **config, **explicit}
    for key in ("ignore", "include"):
        both = [*config.get(key, []), *explicit.get(key, [])]
        if both:
            out[key] = both
    return out


def instructions(value: str | None, folder: str | Path = ".") -> str | None:
    """The text itself, or that of ``@file``."""
    return (Path(folder) / value[1:]).read_text(encoding="utf-8") if value and value.startswith("@") else value


def starter() -> dict:
    return {"format": "markdown", "mode": "skeleton", "comments": "all", "focus": [], "ignore": [], "output": "packed.md", "models": ["gpt-4o"]}


def initialize(folder: str | Path, force: bool = False) -> list[Path]:
    """Write a starter configuration and ignore file where there are none (or anyway)."""
    made = []
    for name, text in ((FILES[0], json.dumps(starter(), indent=2) + "\n"), (".packignore", "# What is never packed, in the form of .gitignore.\n*.snap\n")):
        path = Path(folder) / name
        if force or not path.exists():
            path.write_text(text, encoding="utf-8")
            made.append(path)
    return made


def json_schema() -> dict:
    """The JSON Schema of a configuration file."""
    simple = {"string": {"type": "string"}, "boolean": {"type": "boolean"}, "number": {"type": "number", "minimum": 0}, "strings": {"type": "array", "items": {"type": "string"}}, "size": {"type": ["number", "string"]}, "count": {"type": ["number", "string"]}, "string or boolean": {"type": ["string", "boolean"]}, "languages": {"type": "object", "additionalProperties": {"enum": LANGUAGES}}}
    properties = {k: {**({"enum": list(kind)} if isinstance(kind, tuple) else simple[kind]), "description": said} for k, (kind, said) in SCHEMA.items()}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": "lodestone configuration", "type": "object", "additionalProperties": False, "properties": {"$schema": {"type": "string"}, **properties}}


_FACTORS = {"": 1, "k": 1024, "m": 1024**2, "g": 1024**3}


def size(value: int | float | str) -> int:
    """Bytes of 500, "500kb", "1.5 MiB"."""
    if not isinstance(value, str):
        return int(value)
    text = value.strip().lower().removesuffix("b").removesuffix("i")
    unit = text[-1:] if text[-1:] in "kmg" else ""
    try:
        return round(float(text.removesuffix(unit)) * _FACTORS[unit])
    except ValueError:
        raise ConfigError(f"no size: {value}") from None


def count(value: int | float | str) -> int:
    """Tokens of 50000, "50k", "1.5m"."""
    if not isinstance(value, str):
        return int(value)
    text = value.strip().lower().replace("_", "").replace(",", "")
    factor = {"k": 1000, "m": 1_000_000}.get(text[-1:], 1)
    try:
        return round(float(text[:-1] if factor > 1 else text) * factor)
    except ValueError:
        raise ConfigError(f"no count: {value}") from None
