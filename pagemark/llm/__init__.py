"""Training-data operators: fingerprints, deduplication, classification, packing and more."""
