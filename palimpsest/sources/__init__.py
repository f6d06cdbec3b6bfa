"""Sources of the key-value engine."""
