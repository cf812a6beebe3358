"""Column functions: text, HTML, URLs, vectors."""
