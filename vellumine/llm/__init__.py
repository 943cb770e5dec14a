"""Training-data operators: ten methods over documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
