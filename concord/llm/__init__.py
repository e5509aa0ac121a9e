"""Training-data operators over whole corpora: sharding, deduplication, decontamination, filters and token counts."""
