"""Training-data operators: deduplication, scoring, filtering, mixing and formatting of text tables."""
