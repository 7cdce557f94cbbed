"""Training-data operators: deduplication, mixing, scoring, counting, archives.

Nothing outside this subpackage imports it.
"""
