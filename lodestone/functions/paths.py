"""What a path says about a file: language, fence, kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "zig": "zig", "typescript": "ts cts mts", "tsx": "tsx", "swift": "swift", "solidity": "sol", "scala": "sc scala", "rust": "rs", "ruby": "ru gemspec rake rb",
    "python": "pyw pyi py", "php": "php", "ocaml_interface": "mli", "ocaml": "ml", "objc": "mm m", "lua": "lua", "kotlin": "kts kt", "julia": "jl",
    "javascript": "jsx cjs mjs js", "java": "java", "haskell": "hs", "go": "go", "elixir": "exs ex", "dart": "dart", "csharp": "cs",
    "cpp": "inl tpp ipp h++ hxx hh hpp c++ cxx cc cpp", "c": "h c", "bash": "bash sh", "vue": "vue", "svelte": "svelte", "astro": "astro",
}
LANGUAGE = {e: k for k, v in EXTENSIONS.items() for e in v.split()}
LANGUAGE_FENCE = {k: k for k in EXTENSIONS} | {"typescript": "ts", "javascript": "js", "ocaml_interface": "ocaml", "objc": "objectivec"}
_SAME = "adoc batch cmake css fish graphql hcl html ini json json5 jsonc less mdx nix prisma r rst sass scss sql svg toml vim xml yaml zsh csv groovy"
EXTENSION_FENCE = {e: e for e in _SAME.split() if e not in ("adoc", "batch")} | dict(p.split("=") for p in "yml=yaml tf=hcl ps1=powershell proto=protobuf pl=perl mk=makefile md=markdown htm=html gradle=groovy gql=graphql erl=erlang cfg=ini cmd=batch bat=batch txt=text tex=latex adoc=asciidoc".split())
NAME_FENCE = dict(p.split("=") for p in "vagrantfile=ruby rakefile=ruby procfile=text makefile=makefile justfile=just gnumakefile=makefile gemfile=ruby dockerfile=dockerfile cmakelists.txt=cmake".split())
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs|fixtures?)/|[._-](test|spec)\.[a-z]+$|_test\.[a-z]+$"
DOC_PATH = r"\.(adoc|md|mdx|rst|txt)$|(^|/)(docs?|examples?)/"
PROSE_PATH = r"\.(adoc|asciidoc|markdown|md|mdx|org|rst|tex|textile|txt)$"


def lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map's value, null where it lacks the key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty for names without one or that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """Language of a path: exact names first, then extensions; ``overrides`` maps ``.ext`` or a name."""
    own = overrides or {}
    names = {k: v for k, v in own.items() if not k.startswith(".")}
    table = LANGUAGE | {k[1:].lower(): v for k, v in own.items() if k.startswith(".")}
    by_extension = lookup(table, extension(path))
    return F.coalesce(lookup(names, base_name(path)), by_extension) if names else by_extension


def fence(path: Column) -> Column:
    name = F.lower(base_name(path))
    return F.coalesce(
        lookup(LANGUAGE_FENCE, language(path)),
        lookup(NAME_FENCE, name),
        F.when((name == ".env") | name.startswith(".env."), "dotenv"),
        lookup(EXTENSION_FENCE, extension(path)),
        F.lit("text"),
    )


def omission_rank(path: Column) -> Column:
    """Which files go first: tests, documents, what has no language, code."""
    return F.when(F.lower(path).rlike(TEST_PATH), 0).when(F.lower(path).rlike(DOC_PATH), 1).when(language(path).isNull(), 2).otherwise(3)


def sql_values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(table.items())) + ")"


def language_of(path: str, overrides: dict[str, str] | None = None) -> str | None:
    """:func:`language` of one path, for the driver and the parsers."""
    own = overrides or {}
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    ext = name[dot + 1 :].lower() if dot > 0 else ""
    return own.get(name) or {k[1:].lower(): v for k, v in own.items() if k.startswith(".")}.get(ext) or LANGUAGE.get(ext)


def fence_of(path: str) -> str:
    """:func:`fence` of one path."""
    name = path.rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    env = "dotenv" if name == ".env" or name.startswith(".env.") else None
    return LANGUAGE_FENCE.get(language_of(path) or "") or NAME_FENCE.get(name) or env or EXTENSION_FENCE.get(name[dot + 1 :] if dot > 0 else "", "text")


#: A comment's opening marks; what follows says that a tool wrote the file, or a marker that tools write stands in it.
COMMENT_OPENS = r"(?:/{2,}|#+|/?\*+|--|<!--|;+|['\"]{3})"
GENERATED_SAYS = rf"(?im)^[ \t]*{COMMENT_OPENS}[ \t!]*(?:th(?:is|e) (?:code|file|module) (?:has been|is|was) )?(?:auto(?:matically |-))?(?:code generated|auto-?generated|generated)\b"
GENERATED_MARKS = rf"(?m)^[ \t]*{COMMENT_OPENS}[ \t!]*.*?(?:\bDO NOT EDIT\b|@generated\b)"


def is_generated_head(text: str) -> bool:
    """Whether a comment in the first 600 characters says that a tool wrote the file."""
    return re.search(GENERATED_SAYS, text[:600]) is not None or re.search(GENERATED_MARKS, text[:600]) is not None
