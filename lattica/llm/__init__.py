"""Training-data operators: fingerprints, tokenizers, WARC, near-dedup, mixing, toxicity, shards, search, chat."""
