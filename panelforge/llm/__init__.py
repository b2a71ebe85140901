"""Training-data operators: deduplication, formatting, scoring, mixing and packing of document tables."""
