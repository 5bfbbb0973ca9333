"""Registered queries and write plans."""
