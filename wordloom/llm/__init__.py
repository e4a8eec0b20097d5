"""Operators of a training-data pipeline.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage;
``wordloom.llm.registry`` lists the queries and their SQL twins.
"""
