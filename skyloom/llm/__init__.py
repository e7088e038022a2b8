"""Training-data operators: filtering, deduplication, scanning and tokenising of text corpora."""
