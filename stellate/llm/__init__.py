"""Operators for preparing training data: ten operators over text, pages and embeddings."""
