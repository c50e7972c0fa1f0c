"""Training-data operators: near duplicates, scoring, token counts, archives.

Nothing outside this subpackage imports it.
"""
