"""Registered queries and whole-document plans."""
