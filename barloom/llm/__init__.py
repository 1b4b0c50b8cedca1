"""Operators for preparing training text; their queries are in ``barloom.llm.queries``."""
