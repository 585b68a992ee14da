"""mathgrade sources."""
