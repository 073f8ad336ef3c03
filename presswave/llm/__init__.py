"""Training-data operators: search, chat formatting, quality, dedup, extraction, packing, encoding and archives.

Nothing else in the library imports this subpackage.
"""
