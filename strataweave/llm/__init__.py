"""Operators for large text corpora: scoring, mixing, joining, decontaminating, counting, archiving,
sanitising, searching, sharding and identifying the language of documents.

Nothing else in the library imports this subpackage.
"""
