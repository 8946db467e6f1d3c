"""operators of lexiloom."""
