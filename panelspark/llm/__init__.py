"""Training-data operators: tokenising, scoring, deduplicating, sharding and mixing documents.

Nothing outside this subpackage imports it.
"""
