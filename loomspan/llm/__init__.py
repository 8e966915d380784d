"""Training-data operators: deduplication, filtering, labelling, mixing, encoding and search.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
