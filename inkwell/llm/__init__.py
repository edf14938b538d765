"""Operators for preparing language-model training data, as Spark jobs.

One module per operator; ``queries`` registers them for the driver. Nothing
outside this subpackage imports it.
"""
