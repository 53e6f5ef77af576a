"""Column functions: text, URLs, page features."""
