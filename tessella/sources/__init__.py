"""Sources of the core engine."""
