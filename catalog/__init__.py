"""Registered queries: JSON rows, logs and schemas made from the tables, and what is asked of them."""
