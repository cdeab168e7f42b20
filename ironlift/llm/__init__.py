"""Training-data operators: tokens, packing, archives, decontamination, PII, sharding, dedup, quality."""
