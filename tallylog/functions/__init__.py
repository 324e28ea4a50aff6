"""Column functions: regex dialect, display text, decoding."""
