"""Training-data operators: packing, search, deduplication, mixing, filters and token outputs.

Nothing outside this subpackage imports it.
"""
