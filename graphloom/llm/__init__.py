"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``catalogue`` holds the
registered queries and their SQL.
"""
