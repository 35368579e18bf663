"""Functions of the utility mining engine."""
