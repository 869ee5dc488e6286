"""streaming of the code graph."""
