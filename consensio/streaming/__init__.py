"""Incremental maintenance of counts from an append-only log."""
