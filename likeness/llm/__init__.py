"""Operators that prepare large text corpora for model training.

Nothing outside this subpackage imports it. Each module holds one operator with its own general
interface; ``queries`` wraps them as named queries and ``oracles`` holds their SQL.
"""
