"""Operators for preparing training text, each in a module of its own, and the queries that apply them."""
