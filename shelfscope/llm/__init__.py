"""Training-data operators: extraction, decontamination, deduplication, filtering, formatting, sharding, encoding."""
