"""Functions of the key-value engine."""
