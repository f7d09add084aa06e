"""Column functions; the text ones are also registrable as SQL functions."""
