"""Training-data operators: dedup, quality, PII, packing, tokenization, extraction, search.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
