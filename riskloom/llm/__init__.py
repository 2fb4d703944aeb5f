"""Operators for large training-data pipelines (one module per problem).

Nothing outside this package imports it; queries are in ``queries`` and the
equivalent SQL in ``oracles``.
"""
