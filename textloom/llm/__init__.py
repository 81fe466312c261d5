"""Training-data operators: ten corpus-scale DataFrame operators and their queries."""
