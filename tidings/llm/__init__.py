"""Operators of a training-data pipeline over documents, conversations and web pages."""
