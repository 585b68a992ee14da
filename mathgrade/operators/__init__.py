"""mathgrade operators."""
