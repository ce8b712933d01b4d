"""Training-data operators: deduplication, filtering, scoring, mixing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
