"""Training-data operators: filtering, deduplication, scoring, tokenising and
sharding of text corpora. Nothing else in the library imports this package."""
