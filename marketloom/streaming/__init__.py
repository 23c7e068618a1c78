"""streaming of marketloom."""
