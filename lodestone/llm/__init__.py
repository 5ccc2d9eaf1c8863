"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
Each operator has its own module with a general interface; :mod:`lodestone.llm.registry`
holds the thin queries and their SQL.
"""
