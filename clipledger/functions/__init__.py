"""Column-level building blocks and skew-safe scan helpers."""
