"""functions of lexiloom."""
