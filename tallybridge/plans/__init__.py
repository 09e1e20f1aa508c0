"""Whole plans: the linkage run, its command line, the query catalogue."""
