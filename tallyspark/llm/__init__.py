"""Operators of a training-data pipeline over the tables documents and embeddings.

One module an operator; ``queries`` registers a query for each. Nothing else in
the library imports this subpackage.
"""
