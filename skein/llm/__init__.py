"""Training-data operators: deduplication, quality, packing, tokenization and media columns."""
