"""Readers of JSON rows, schema logs and schema documents, and the result sink."""
