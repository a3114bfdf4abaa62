"""Training-data operators: token counts, quality, packing, near-duplicates, extraction, output and decontamination.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and their SQL.
"""
