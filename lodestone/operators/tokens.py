"""Token counters: a column expression that needs no vocabulary, and the tokenizers library for exact counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators.stats import token_proxy

#: Text column to a column of counts.
Counter = Callable[[Column], Column]
proxy: Counter = token_proxy


def library_counter(path: str) -> Counter:
    """Exact counts by the tokenizers library, in Arrow batches; the file is read once a worker. Special strings count as the library's default has it."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tok = _loaded(path)
        return pd.Series([len(e.ids) for e in tok.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return lambda text: count(text)


_LOADED: dict[str, object] = {}


def _loaded(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def exact_or_estimated(estimate: int, exact: Mapping[str, int], model: str) -> tuple[int, bool]:
    """A model's count: the exact one that was injected for it, else the estimate; and whether it is exact."""
    return (exact[model], True) if model in exact else (estimate, False)
