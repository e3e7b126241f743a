"""Column expressions: URLs, languages, text."""
