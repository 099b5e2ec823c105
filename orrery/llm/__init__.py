"""Training-data operators: tokenization, classifiers, packing, deduplication, media, sharding."""
