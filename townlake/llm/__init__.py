"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it.
"""
