"""Operators of a training-data pipeline (text, HTML, URLs, tokens).

Nothing else in the library imports this subpackage; it may import general
helpers of the library.  ``queries`` registers one query per operator.
"""
