"""Training-data operators: filtering, near-duplicates, mixing, packing, search, archives."""
