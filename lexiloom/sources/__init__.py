"""sources of lexiloom."""
