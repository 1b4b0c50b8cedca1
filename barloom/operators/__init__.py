"""Operators over series, documents and state."""
