"""Operators for preparing large text corpora on Spark.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
