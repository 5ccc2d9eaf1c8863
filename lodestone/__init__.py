"""Corpus analytics on Spark: trees of text as token-budgeted documents, and what they hold.

Names are imported when first used, so that worker processes load only the modules that they need.
"""

from importlib import import_module

_HOMES = {
    "api": "Pack fit markdown ordered pack render render_part split statistics totals variants write",
    "cache": "CacheStore ParquetCache",
    "documents": "RENDERERS Options Part",
    "operators.fitting": "Fit fit_to_budget ladder",
    "operators.graph": "dependency_graph most_imported related",
    "operators.parsers": "PARSERS register",
    "operators.parsing": "notebook_script outline skeleton transform_text",
    "operators.search": "search top_hits",
    "operators.tokens": "library_counter proxy",
    "operators.transform": "redact_text redacted",
    "session": "build_session",
    "sources.remote": "changed_files clone diff_text last_changed parse_spec",
    "sources.walk": "read_tree",
}
_HOME = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(f"lodestone.{_HOME[name]}"), name)
    raise AttributeError(f"module 'lodestone' has no attribute {name!r}")
