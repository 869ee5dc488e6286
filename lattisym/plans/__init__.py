"""plans of the code graph."""
