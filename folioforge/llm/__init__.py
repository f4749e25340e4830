"""Training-data operators: the ten text, media and vector operators and their queries."""
