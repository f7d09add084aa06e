"""Readers that yield commit rows, datasets and column frames."""
