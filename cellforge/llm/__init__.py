"""Training-data operators: deduplication, search, scanning, tokenisation, packing.

Nothing else in the library imports this subpackage.
"""
