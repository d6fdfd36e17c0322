"""Training-data operators: licence scans, near-duplicates, toxicity, mixing, secrets, languages, tokens, packing, quality, search."""
