"""Joins, folds, aggregations and rule checks as DataFrame functions."""
