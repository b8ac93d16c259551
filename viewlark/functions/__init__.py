"""Predicates and expressions: each is a Spark ``Column`` in the end."""
