"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own interface; ``registry`` holds the thin queries built on them.
"""
