"""Operators over pair and record tables."""
