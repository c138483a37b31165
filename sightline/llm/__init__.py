"""Training-data operators: tokenising, packing, near-duplicates, classifiers, web archives."""
