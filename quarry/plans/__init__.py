"""Plans of the utility mining engine."""
