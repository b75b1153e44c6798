"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each operator module holds the
general operator; ``queries`` applies the ten operators to the test tables.
"""
