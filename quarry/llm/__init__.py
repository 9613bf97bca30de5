"""Training-data operators: quality, deduplication, tokenisation, packing and scoring of document tables."""
