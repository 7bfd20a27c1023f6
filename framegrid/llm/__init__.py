"""Operators for preparing training text: one module per operator.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
