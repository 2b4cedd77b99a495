"""Operators for building language-model training data, one module each.

Nothing outside this folder imports it; ``catalogue`` lists its queries.
"""
