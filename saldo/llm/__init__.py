"""Operators of a training-data pipeline over documents, pages, benchmark items, labels and conversations."""
