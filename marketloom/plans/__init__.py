"""plans of marketloom."""
