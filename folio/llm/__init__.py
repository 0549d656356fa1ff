"""Training-data operators: quality rules, packing, dedup, token files, WARC, chat, media, tokenisation.

Nothing else in the library imports this subpackage.
"""
