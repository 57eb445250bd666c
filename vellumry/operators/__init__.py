"""Distributed operators on tables."""
