"""operators of the code graph."""
