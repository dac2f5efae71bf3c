"""Operators of a training-data pipeline and the queries bound to them."""
