"""Scalar functions and size models as column expressions."""
