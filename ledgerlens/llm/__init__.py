"""Operators of a large-scale training-data pipeline (documents, pages, conversations)."""
