"""mathgrade streaming."""
