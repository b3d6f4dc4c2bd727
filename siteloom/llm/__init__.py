"""Training-data operators: deduplication, decontamination, quality, privacy, tokens, search, shards."""
