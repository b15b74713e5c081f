"""Training-data operators: tokenisation, deduplication, filtering, search and packing.

Nothing outside this subpackage imports it.  Each operator module has a general
entry point and a docstring that states what it does with nulls, ties, repeated
rows and empty tables; ``registry`` holds the thin contract queries.
"""
