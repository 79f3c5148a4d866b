"""Operators for building training corpora at scale.

Each module holds one operator with its own general interface; ``queries``
holds the thin contract queries.  Nothing else in the library imports this
subpackage.
"""
