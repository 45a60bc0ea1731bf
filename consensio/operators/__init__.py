"""Operators: agreement, dependence, resampling, decisions, and table hygiene."""
