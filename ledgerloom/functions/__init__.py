"""Scalar rules as Column builders; no Python runs per row."""
