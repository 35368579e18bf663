"""Sources of the utility mining engine."""
