"""Whole conversions put together from sources, operators and functions."""
