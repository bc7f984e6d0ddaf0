"""Whole builds composed of the operators."""
