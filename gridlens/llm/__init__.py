"""Training-data operators: formatting, archives, scoring, deduplication and mixing."""
