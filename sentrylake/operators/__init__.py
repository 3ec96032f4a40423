"""Operators: column builders and DataFrame functions."""
