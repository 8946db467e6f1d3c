"""plans of lexiloom."""
