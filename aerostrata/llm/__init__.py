"""Training-data operators for corpora of documents, pages, vectors and conversations.

Nothing outside this subpackage imports it.
"""
