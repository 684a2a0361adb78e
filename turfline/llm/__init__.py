"""Training-data operators: filtering, deduplication, mixing, scoring and output."""
