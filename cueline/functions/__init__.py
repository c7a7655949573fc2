"""Column expressions for text and time codes."""
