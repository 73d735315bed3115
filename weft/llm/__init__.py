"""Operators for training data made of source code and text.

Nothing outside this package imports it; ``weft.llm.queries`` lists its queries.
"""
