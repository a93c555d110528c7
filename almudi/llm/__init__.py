"""Operators for preparing language-model training data and model-based catalogue work.

Nothing outside this subpackage imports it.
"""
