"""Operators for preparing training text, media and embeddings at scale.

Nothing outside this subpackage imports it.
"""
