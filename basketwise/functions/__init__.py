"""Scalar column expressions; every one is a built-in expression tree."""
