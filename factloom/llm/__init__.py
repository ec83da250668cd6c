"""Training-data operators: everything here is independent of the rest of the library."""
