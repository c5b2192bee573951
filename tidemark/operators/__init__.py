"""Operators over whole tables of points."""
