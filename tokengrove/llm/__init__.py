"""Operators that prepare training data for language models.

One module per operator, each over plain DataFrames; :mod:`tokengrove.llm.queries` applies
them to the test tables. Nothing outside this package imports it.
"""
