"""Operators for large training corpora: tokens, language, deduplication, packing, archives, search, secrets, alignment and audit.

Nothing else in the library imports this subpackage; `queries.py` registers one query per operator.
"""
