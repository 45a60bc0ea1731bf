"""Operators on model texts and corpora. Nothing outside this folder imports it."""
