"""Training-data operators: quality, near-duplicates, packing, language models, sharding and mixing."""
