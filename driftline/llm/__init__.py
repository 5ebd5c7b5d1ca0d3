"""Training-data operators: packing, near-duplicate joins, filters, codecs, extraction and search.

Nothing outside this subpackage imports it.
"""
