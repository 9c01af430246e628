"""Generic DataFrame operators; column names and thresholds are parameters."""
