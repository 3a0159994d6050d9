"""Operators of a training-data pipeline over ``documents``.

Each module holds one operator with its own interface; ``queries`` turns
them into the registered ``opN_`` queries.  Nothing outside this
subpackage imports it.
"""
