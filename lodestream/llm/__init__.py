"""Training-data operators: thirteen dealt operators, their queries and their SQL."""
