"""Registered queries over the reference's own operators."""
