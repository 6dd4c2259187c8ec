"""Column helpers (SURVEY section I)."""
