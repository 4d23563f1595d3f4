"""Validation, issue, measure and distance operators."""
