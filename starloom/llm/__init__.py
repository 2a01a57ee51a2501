"""Training-data operators: dedup, search, archives, token files, packing, PII, quality."""
