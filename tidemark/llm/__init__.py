"""Training-data operators: filters, deduplication, classifiers, tokenisation, packing and web archives.

Nothing else in the library imports this subpackage.
"""
