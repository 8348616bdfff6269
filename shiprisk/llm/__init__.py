"""Operators for preparing language-model training data, one module each.

Nothing else in the library imports this subpackage. ``catalog`` maps the
query names to functions ``(spark, sf_dir) -> DataFrame``.
"""
