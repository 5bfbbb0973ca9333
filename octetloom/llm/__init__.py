"""Training-data operators: quality, packing, mixing, fingerprints, secrets,
language-model scores, shards, toxicity, near-duplicates and exact search."""
