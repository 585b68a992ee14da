"""mathgrade plans."""
