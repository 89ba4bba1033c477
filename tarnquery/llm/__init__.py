"""Training-data operators: deduplication, scoring, filtering, formatting and mixing of text corpora."""
