"""The stateless stages, and deduplication, on streams."""
