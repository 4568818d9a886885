"""Scalar functions: text cleaning, confusion model, similarity metrics, code grammar."""
