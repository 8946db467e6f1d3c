"""streaming of lexiloom."""
