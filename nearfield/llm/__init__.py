"""Training-data operators: dedup, extraction, filtering, scoring, mixing, encoding.

Nothing outside this subpackage imports it.  Each operator lives in a module of its own and has a general DataFrame
interface; ``queries`` holds the thin registered queries and their SQL.
"""
