"""Training-data operators: mixing, packing, duplicates, quality, toxicity, archives and personal data."""
