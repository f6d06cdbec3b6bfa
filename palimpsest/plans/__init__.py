"""Plans of the key-value engine."""
