"""Training-data operators: thirteen batch operators over documents, pages and vectors.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
