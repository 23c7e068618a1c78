"""functions of marketloom."""
