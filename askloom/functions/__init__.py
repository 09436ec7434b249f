"""Column expressions: text, scores and the parsing of replies."""
