"""Training-data operators: filtering, de-duplication, search, mixing and packing."""
