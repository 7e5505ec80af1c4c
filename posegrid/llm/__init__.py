"""Training-data operators: language, quality, duplicates, secrets, packing, scoring, search."""
