"""Graph files and tables."""
