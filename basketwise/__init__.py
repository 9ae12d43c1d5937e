"""Retail customer analytics on Spark DataFrames.

Three tables (transactions, households, products) go in; dashboard aggregates,
customer features, product pairs, recommendations and tree-model scores come
out, all as lazily planned DataFrames.
"""
