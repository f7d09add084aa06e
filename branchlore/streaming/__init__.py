"""The same work over commits that keep arriving."""
