"""Relational operators over curated tables."""
