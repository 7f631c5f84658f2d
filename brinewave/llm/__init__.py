"""Operators for preparing training text: scoring, privacy, matching, packaging and mixing of documents."""
