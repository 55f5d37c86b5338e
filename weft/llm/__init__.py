"""Training-data operators for large corpora.

Nothing outside this package imports it, so the folder can be removed without
touching the query engine.
"""
