"""Training-data pipeline operators (deduplication, filters, scoring, mixing, sharding)."""
