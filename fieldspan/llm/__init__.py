"""Training-data operators: dedup, quality, toxicity, PII, mixing, search, BPE."""
