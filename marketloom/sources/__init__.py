"""sources of marketloom."""
