"""Training-data operators: deduplication, packing, extraction, filtering, tokenisation.

Nothing else in the library imports this subpackage.
"""
