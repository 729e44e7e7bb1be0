"""Operators that prepare language-model training corpora.

Nothing outside this subpackage imports it, so it can be removed whole.
"""
