"""queries of marketloom."""
