"""sources of the code graph."""
