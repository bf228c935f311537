"""Training-data operators: ten components over documents, pages and conversations.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
