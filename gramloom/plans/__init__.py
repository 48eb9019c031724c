"""Whole builds: from strings to a stored grammar."""
