"""Column helpers: guarded arithmetic, code strings and weighted aggregates."""
