"""Registered queries and the end-to-end catalog workflow."""
