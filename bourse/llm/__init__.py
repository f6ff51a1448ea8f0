"""Training-data operators: formatting, deduplication, filtering, packing."""
