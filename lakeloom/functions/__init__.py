"""Column expressions and shared intermediates."""
