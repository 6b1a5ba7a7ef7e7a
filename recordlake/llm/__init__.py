"""Training-data operators: filters, token counts, deduplication, scans, packing.

Nothing outside this package imports it, so it can be removed as a whole.
"""
