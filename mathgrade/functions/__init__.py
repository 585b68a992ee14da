"""mathgrade functions."""
