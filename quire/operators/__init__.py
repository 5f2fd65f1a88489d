"""Joins, windows and aggregates over relational documents."""
