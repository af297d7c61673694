"""Training-data operators: dedup, scoring, token counts, packing, URL filters, decontamination.

Nothing outside this subpackage imports it, and it imports nothing of the rest of the library.
"""
