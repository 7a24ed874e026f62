"""Column expressions used across operators."""
